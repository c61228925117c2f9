"""Quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes, each marked with whether the eight bytes from it on also
stand 3 to 24 bytes before, are embedded and met by learned filters over
overlapping chunks that cover the whole text. Each filter is max-pooled over
every chunk; the largest and the mean pooled value of each filter go through a
small dense layer into one probability. Forward, backward and the optimizer are
written here; the network learns from a bounded labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import utf8
from starling.llm.labels import held_out, labelled_sample

# At most this many labelled rows of each class are learned from.
ROWS_PER_CLASS = 1500
# Labelled texts of more bytes take no part in learning, so the sample's memory has a bound; scoring takes whole texts.
LEARN_BYTES = 1 << 17
EPOCHS = 10
BATCH = 32
RATE = 0.01
SEED = 7

WIDTH, STRIDE, FILTERS, EMBEDDING, HIDDEN = 6, 2, 16, 8, 16
# Filter places in a chunk; a chunk's last filters reach into the next chunk.
CHUNK = 256
ECHO_BYTES, ECHO_FROM, ECHO_TO = 8, 3, 24
PAD = 512
# Filter places worked on at once, so that memory does not grow with the text.
SLICE = 1 << 14


def symbols(text: str | None) -> np.ndarray:
    """Byte values, plus 256 where the next bytes repeat recent ones."""
    raw = np.frombuffer(utf8(text), dtype=np.uint8)
    out = raw.astype(np.int16)
    for begin in range(0, len(raw) - ECHO_BYTES + 1, SLICE):
        low = max(0, begin - ECHO_TO)
        part = raw[low : begin + SLICE + ECHO_BYTES - 1].astype(np.uint64)
        grams = np.zeros(len(part) - ECHO_BYTES + 1, dtype=np.uint64)
        for k in range(ECHO_BYTES):
            grams |= part[k : k + len(grams)] << np.uint64(8 * k)
        echo = np.zeros(len(grams), dtype=bool)
        for p in range(ECHO_FROM, min(ECHO_TO, len(grams) - 1) + 1):
            echo[p:] |= grams[p:] == grams[:-p]
        own = echo[begin - low :]
        out[begin : begin + len(own)] += own.astype(np.int16) * 256
    return out


def _places(n: int) -> int:
    """Filter places of a text of n bytes: all that touch it, one at least."""
    return max(1, -(-n // STRIDE))


@dataclass
class ByteNetwork:
    """Parameters by name; without ``fit`` it scores a constant."""

    constant: float | None = None
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def _start(self) -> None:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "e": draw(PAD + 1, EMBEDDING, scale=0.5), "w": draw(WIDTH, EMBEDDING, FILTERS, scale=(WIDTH * EMBEDDING) ** -0.5), "b": np.zeros(FILTERS, np.float32),
            "w1": draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN, scale=HIDDEN**-0.5), "b2": np.zeros(1, np.float32),
        }
        self.p["e"][PAD] = 0

    def tables(self) -> np.ndarray:
        """What each symbol adds to each filter at each offset."""
        return np.einsum("se,oef->osf", self.p["e"], self.p["w"])

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(pooled @ self.p["w1"] + self.p["b1"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"][0], -30, 30)))

    def pool(self, text: str | None, tables: np.ndarray) -> np.ndarray:
        """Largest and mean chunk maximum of every filter."""
        own = symbols(text)
        places = _places(len(own))
        chunks = -(-places // CHUNK)
        tops = np.empty((chunks, FILTERS), dtype=np.float32)
        step = SLICE // CHUNK
        for c in range(0, chunks, step):
            first, last = c * CHUNK, min(places, (c + step) * CHUNK)
            need = (last - first - 1) * STRIDE + WIDTH
            part = own[first * STRIDE : first * STRIDE + need]
            part = np.concatenate([part, np.full(need - len(part), PAD, np.int16)])
            out = tables[0].take(part[: (last - first) * STRIDE : STRIDE], axis=0)
            for o in range(1, WIDTH):
                out += tables[o].take(part[o : o + (last - first - 1) * STRIDE + 1 : STRIDE], axis=0)
            tops[c : c + step] = np.maximum.reduceat(out, np.arange(0, last - first, CHUNK), axis=0)
        tops = np.maximum(tops + self.p["b"], 0)
        return np.concatenate([tops.max(axis=0), tops.mean(axis=0)])

    def score(self, texts: list[str | None] | pd.Series) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        tables = self.tables()
        return self._head(np.stack([self.pool(t, tables) for t in texts]))[1].astype(float)

    def fit(self, texts: list[str | None], labels: np.ndarray, weights: np.ndarray) -> ByteNetwork:
        self._start()
        rng = np.random.default_rng(SEED)
        streams = [symbols(t) for t in texts]
        weights = weights / weights.mean()
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                gradients = self._gradients([streams[i] for i in own], labels[own], weights[own])
                step += 1
                rate = RATE * (1 - 0.9 * step / steps)
                for name, g in gradients.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.p["e"][PAD] = 0
        return self

    def _gradients(self, streams: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss; through a maximum they flow to the byte places that gave it."""
        tables, span = self.tables(), (CHUNK - 1) * STRIDE + WIDTH
        tops, best, windows, sizes = [], [], [], []
        for own in streams:
            chunks = -(-_places(len(own)) // CHUNK)
            padded = np.concatenate([own, np.full(chunks * CHUNK * STRIDE + WIDTH - len(own), PAD, np.int16)])
            rows = np.stack([padded[c * CHUNK * STRIDE : c * CHUNK * STRIDE + span] for c in range(chunks)])
            out = sum(tables[o].take(rows[:, o : o + (CHUNK - 1) * STRIDE + 1 : STRIDE], axis=0) for o in range(WIDTH))
            valid = np.arange(chunks * CHUNK).reshape(chunks, CHUNK) < _places(len(own))
            out = np.where(valid[:, :, None], out, -np.inf)
            top = out.argmax(axis=1)
            tops.append(np.take_along_axis(out, top[:, None, :], axis=1)[:, 0, :])
            best.append(top)
            windows.append(rows)
            sizes.append(chunks)
        raw = np.concatenate(tops) + self.p["b"]
        live = np.maximum(raw, 0)
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counts = np.array(sizes)
        largest, mean = np.maximum.reduceat(live, heads, axis=0), np.add.reduceat(live, heads, axis=0) / counts[:, None]
        pooled = np.concatenate([largest, mean], axis=1)
        hidden, p = self._head(pooled)
        d_out = ((p - labels) * weights / len(labels)).astype(np.float32)
        d_hidden = np.outer(d_out, self.p["w2"]) * (1 - hidden**2)
        d_pooled = d_hidden @ self.p["w1"].T
        doc = np.repeat(np.arange(len(sizes)), counts)
        d_live = d_pooled[doc, FILTERS:] / counts[doc][:, None]
        d_live += d_pooled[doc, :FILTERS] * (live == largest[doc]) / np.add.reduceat(live == largest[doc], heads, axis=0, dtype=float)[doc]
        d_live = np.where(raw > 0, d_live, 0).astype(np.float32)
        rows, at = np.concatenate(windows), np.concatenate(best) * STRIDE
        d_e, d_w = np.zeros_like(self.p["e"]), np.zeros_like(self.p["w"])
        for o in range(WIDTH):
            seen = np.take_along_axis(rows, at + o, axis=1)
            d_w[o] = np.einsum("cfe,cf->ef", self.p["e"][seen], d_live)
            np.add.at(d_e, seen, d_live[:, :, None] * self.p["w"][o].T[None, :, :])
        return {"e": d_e, "w": d_w, "b": d_live.sum(axis=0), "w1": pooled.T @ d_hidden, "b1": d_hidden.sum(axis=0), "w2": hidden.T @ d_out, "b2": np.array([d_out.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ByteNetwork:
    """Learn from at most ``rows_per_class`` labelled rows of each class outside the held-out fold.

    Of those, texts of more than ``LEARN_BYTES`` bytes are left out. With labels
    of one class only the model scores that class's value, without labels 0.
    """
    sample, weights = labelled_sample(docs, labels, "quality", rows_per_class, id_col, text_col)
    sample = sample.where(F.octet_length(F.coalesce("text", F.lit(""))) <= LEARN_BYTES)
    rows = sample.orderBy("u", "label", "text").toPandas()
    if rows["label"].nunique() < 2:
        return ByteNetwork(constant=float(rows["label"].max()) if len(rows) else 0.0)
    y = rows["label"].to_numpy(dtype=np.float32)
    return ByteNetwork().fit(rows["text"].tolist(), y, np.where(y > 0, weights[1], weights[0]).astype(np.float32))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Null texts score as empty ones, repeated rows score alike, null ids count as
    not held out, other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.tolist()), dtype=float)

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
