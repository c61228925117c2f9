"""Repeated word windows across documents, found by recompression.

Every document's words go through rounds of recompression: runs of one symbol
become one symbol, then pairs of a left and a right symbol become one. Names are
hashes of what a symbol stands for, so equal strings get equal names in every
task, and inside equal strings the rounds draw the same boundaries except near
the ends. Two levels are used.

High symbols (``HIGH_ROUNDS`` rounds, some 30 words) settle long repeats: the
windows that start in a high symbol are known to repeat once the symbol's whole
string, with the words its windows reach into, also occurs earlier.

Low symbols find what is left. A window of 20 words leaves room for
``LOW_ROUNDS`` rounds; of the low symbols that start far enough inside it, the
one with the smallest name (its first ``NAME_WORDS`` words hashed) stands for the
window. Windows around names that occur once in the corpus cannot repeat; the
others are verified by 96-bit hashes of all their words, and all occurrences but
the first are cut.

Tasks work on chunks of documents and send each name, string or window once per
chunk, so a passage in a third of all documents becomes one row per chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from starling.functions.ranks import with_dense_index
from starling.llm.common import has_repeats, measured, utf8
from starling.session import cut_lineage

NAME_WORDS = 8
# Words around a symbol's start that decide whether two rounds start one there.
LEFT_CONTEXT = 3
LOW_ROUNDS, HIGH_ROUNDS = 2, 12
CHUNK_WORDS = 1 << 18
NONE = np.uint64(2**64 - 1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def recompress(names: np.ndarray, starts: np.ndarray, opens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the new symbols' names and the words at which they start.

    ``opens`` tells the words that begin a document; no symbol reaches over them.
    """
    salt = np.uint64(level * 0x632BE59BD9B4E019 % 2**64)
    if not len(names):
        return names, starts
    head = np.ones(len(names), dtype=bool)
    head[1:] = (names[1:] != names[:-1]) | opens[starts[1:]]
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    letters, starts = names[at], starts[at]
    runs = np.where(length > 1, _mix(letters ^ _mix(length + salt)), letters)
    right = (_mix(letters + salt) >> np.uint64(40)) & np.uint64(1) == 1
    second = np.zeros(len(at), dtype=bool)
    second[1:] = ~right[:-1] & right[1:] & ~opens[starts[1:]]
    first = np.flatnonzero(~second)
    paired = np.append(second[1:], False)[first]
    following = runs[np.minimum(first + 1, len(runs) - 1)]
    pairs = _mix(runs[first] * np.uint64(BASES[0]) + following * np.uint64(BASES[1]) + salt)
    return np.where(paired, pairs, runs[first]), starts[first]


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in BASES]


def _sums(words: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the words times powers, and the inverse powers."""
    up, down = _POWERS[which].upto(len(words) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)]), down


def _string_hashes(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the word strings between starts and stops."""
    return _mix((sums[0][stops] - sums[0][starts]) * sums[1][starts] + (stops - starts).astype(np.uint64) * np.uint64(BASES[0]))


class Chunk:
    """The words of some documents, one after another, as hashes."""

    def __init__(self, keys: list[int], words: list[list[bytes]], window: int) -> None:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        digest = xxhash.xxh64_intdigest
        self.window, self.keys, self.sums = window, np.array(keys, dtype=np.int64), None
        self.words = np.array([digest(w) for doc in words for w in doc], dtype=np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.doc_of = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(len(self.words)) + window <= self.offsets[self.doc_of + 1]
        self.starts = np.flatnonzero(inside)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document key and word position in the document."""
        doc = self.doc_of[at]
        return self.keys[doc], at - self.offsets[doc]

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 31 bits for each string."""
        if self.sums is None:
            self.sums = [_sums(self.words, k) for k in (0, 1)]
        first, second = (_string_hashes(s, starts, stops) for s in self.sums)
        return first, (second >> np.uint64(33)).astype(np.int32)

    def levels(self) -> Iterator[np.ndarray]:
        """The words at which symbols start, after each round."""
        opens = np.zeros(len(self.words), dtype=bool)
        opens[self.offsets[:-1]] = True
        symbols, at = self.words, np.arange(len(self.words))
        for level in range(1, HIGH_ROUNDS + 1):
            symbols, at = recompress(symbols, at, opens, level)
            yield at

    def anchors(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window its anchor word, and the names of all words.

        Both depend on the window's own words alone: a window without equal
        neighbouring words takes the smallest name among low symbol starts
        whose context lies inside it; any other window, and one without such a
        start, takes a fixed place.
        """
        at = np.arange(max(0, len(self.words) - NAME_WORDS + 1))
        names, _ = self.hashes(at, at + NAME_WORDS)
        if not len(self.starts):
            return self.starts, names
        usable = np.full(len(names), NONE)
        low = low[low < len(names)]
        usable[low] = names[low]
        places = self.window - NAME_WORDS - LEFT_CONTEXT + 1
        best = sliding_window_view(usable, places).argmin(axis=1)[self.starts + LEFT_CONTEXT]
        equal = np.concatenate([[0, 0], np.cumsum(self.words[1:] == self.words[:-1])])
        running = equal[self.starts + self.window] > equal[self.starts + 1]
        unnamed = usable[self.starts + LEFT_CONTEXT + best] == NONE
        best[running | unnamed] = 0
        return self.starts + LEFT_CONTEXT + best, names

    def blocks(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each high symbol."""
        ends = self.offsets[self.doc_of[high] + 1] - self.window + 1
        size = np.minimum(np.append(high[1:], len(self.words)), ends) - high
        return high[size > 0], size[size > 0]


def _chunks(keys: list, texts: list, window: int, extra: list | None = None) -> Iterator[tuple[Chunk, list]]:
    held: list[tuple] = []
    size = 0
    for i, (key, text) in enumerate(zip(keys, texts)):
        words = utf8(text).split()
        if len(words) < window:
            continue
        held.append((key, words, extra[i] if extra else None))
        size += len(words)
        if size >= CHUNK_WORDS:
            yield Chunk([h[0] for h in held], [h[1] for h in held], window), [h[2] for h in held]
            held, size = [], 0
    if held:
        yield Chunk([h[0] for h in held], [h[1] for h in held], window), [h[2] for h in held]


PLACE = pa.struct([("key", pa.int64()), ("pos", pa.int32())])
NAME_SCHEMA = pa.schema([("name", pa.int64()), ("check", pa.int32()), ("key", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("more", pa.list_(PLACE))])
WINDOW_SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _later(new: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows at another place than the first of their group."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (keys != keys[head]) | (pos != pos[head])


def _name_rows(chunk: Chunk) -> Iterator[pa.RecordBatch]:
    """Rows of size 0: a name with its first place in the chunk, and further ones.

    Rows of positive size: a high symbol's string at its first place, with its
    windows. Rows of negative size: the same at further places.
    """
    levels = list(chunk.levels())
    anchor, names = chunk.anchors(levels[LOW_ROUNDS - 1])
    at = np.unique(anchor)
    at = at[np.argsort(names[at], kind="stable")]
    first = _firsts(names[at])
    heads, rest = np.flatnonzero(first), np.flatnonzero(~first)
    sizes = np.diff(np.append(heads, len(at)))
    keys, pos = chunk.place(at)
    offsets = np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int32)
    places = pa.StructArray.from_arrays([pa.array(keys[rest]), pa.array(pos[rest].astype(np.int32))], fields=list(PLACE))
    lists = pa.ListArray.from_arrays(pa.array(offsets), places, mask=pa.array(sizes == 1))
    zeros = pa.array(np.zeros(len(heads), np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[at[heads]].view(np.int64)), zeros, pa.array(keys[heads]), pa.array(pos[heads].astype(np.int32)), zeros, lists.cast(NAME_SCHEMA.field("more").type)], schema=NAME_SCHEMA
    )
    starts, size = chunk.blocks(levels[-1])
    name, check = chunk.hashes(starts, starts + size + chunk.window - 1)
    keys, pos = chunk.place(starts)
    order = np.lexsort((pos, keys, check, name))
    name, check, keys, pos, size = name[order], check[order], keys[order], pos[order], size[order]
    new = _firsts(name, check)
    later = _later(new, keys, pos)
    sent = new | later
    name = np.where(later, _mix(name + keys.view(np.uint64) * np.uint64(BASES[1]) + pos.astype(np.uint64)), name)
    columns = [name.view(np.int64), check, keys, pos.astype(np.int32), np.where(later, -size, size).astype(np.int32)]
    yield pa.RecordBatch.from_arrays([*(pa.array(c[sent]) for c in columns), pa.nulls(int(sent.sum()), NAME_SCHEMA.field("more").type)], schema=NAME_SCHEMA)


def _window_rows(chunk: Chunk, marks: list) -> pa.RecordBatch:
    """The chunk's candidate windows: the first of each as a row to compare, the others as spans to cut."""
    low = next(at for i, at in enumerate(chunk.levels(), start=1) if i == LOW_ROUNDS)
    anchor, _ = chunk.anchors(low)
    marked, open_ = np.zeros(len(chunk.words), dtype=bool), np.ones(len(chunk.words), dtype=bool)
    for doc, (own, starts, stops) in enumerate(marks):
        marked[chunk.offsets[doc] + unpacked(own)] = True
        for a, b in zip(starts, stops):
            open_[chunk.offsets[doc] + a : chunk.offsets[doc] + b] = False
    at = chunk.starts[marked[anchor] & open_[chunk.starts]]
    h1, h2 = chunk.hashes(at, at + chunk.window)
    keys, pos = chunk.place(at)
    order = np.lexsort((pos, keys, h2, h1))
    h1, h2, keys, pos = h1[order], h2[order], keys[order], pos[order]
    new = _firsts(h1, h2)
    later = _later(new, keys, pos)
    cut_keys, cut_starts, cut_stops = merge_spans(keys[later], pos[later], pos[later] + chunk.window)
    n, m = int(new.sum()), len(cut_keys)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([h1[new].view(np.int64), _mix(cut_keys.view(np.uint64) + cut_starts.astype(np.uint64)).view(np.int64)])),
        pa.array(np.concatenate([h2[new], np.full(m, -1, np.int32)]).astype(np.int32)),
        pa.array(np.concatenate([keys[new], cut_keys])),
        pa.array(np.concatenate([pos[new], cut_starts]).astype(np.int32)),
        pa.array(np.concatenate([np.zeros(n, np.int32), cut_stops]).astype(np.int32)),
    ], schema=WINDOW_SCHEMA)


def merge_spans(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one key become one."""
    if not len(keys):
        return keys.astype(np.int64), starts.astype(np.int64), stops.astype(np.int64)
    order = np.lexsort((starts, keys))
    keys, starts, stops = keys[order], starts[order].astype(np.int64), stops[order].astype(np.int64)
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    block = np.cumsum(fresh) - 1
    width = int(stops.max()) + 1
    reach = np.maximum.accumulate(stops + block * width) - block * width
    fresh[1:] |= starts[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(keys)) - 1
    return keys[heads], starts[heads], reach[tails]


def _per_key(lists):
    """A ``mapInArrow`` function that calls ``lists`` with the long columns of whole keys, from rows sorted by the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            cut = int(np.searchsorted(part[0], part[0][-1]))
            if cut or (held and held[0][0][0] != part[0][0]):
                ready = [*held, [c[:cut] for c in part]]
                yield lists(*(np.concatenate(c) for c in zip(*ready)))
                held = [[c[cut:] for c in part]]
            else:
                held.append(part)
        if held:
            yield lists(*(np.concatenate(c) for c in zip(*held)))

    return run


def _lists_of(keys: np.ndarray, own: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """The values of each of ``keys``; ``own`` tells their keys, sorted."""
    offsets = np.append(np.searchsorted(own, keys, side="left"), len(own)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32))).cast(pa.list_(pa.int32()))


STEP = 65535


def _packed(keys: np.ndarray, own: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """The rising values of each of ``keys`` as 16-bit steps; a full step only moves on."""
    before = np.zeros(len(values), dtype=np.int64)
    same = own[1:] == own[:-1]
    before[1:][same] = values[:-1][same]
    full, rest = np.divmod(values - before, STEP)
    ends = np.cumsum(full + 1)
    steps = np.full(int(ends[-1]) if len(ends) else 0, STEP, dtype="<u2")
    steps[ends - 1] = rest
    offsets = 2 * np.concatenate([[0], ends])[np.append(np.searchsorted(own, keys, side="left"), len(own))]
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(steps.tobytes())])


def unpacked(steps: bytes) -> np.ndarray:
    steps = np.frombuffer(steps, dtype="<u2")
    return np.cumsum(steps, dtype=np.int64)[steps < STEP]


def _span_lists(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    keys, starts, stops = merge_spans(keys, starts, stops)
    own = np.unique(keys)
    schema = pa.schema([("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])
    return pa.RecordBatch.from_arrays([pa.array(own), _lists_of(own, keys, starts), _lists_of(own, keys, stops)], schema=schema)


def _mark_lists(window: int):
    """Rows (key, pos, size) to each document's settled windows, and the marks that other windows still need."""
    schema = pa.schema([("key", pa.int64()), ("marks", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("starts", "stops"))])

    def lists(keys: np.ndarray, pos: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        block = size > 0
        own = np.unique(keys)
        mark_keys, marks = keys[~block], pos[~block]
        keys, starts, stops = merge_spans(keys[block], pos[block], pos[block] + size[block])
        if len(keys) and len(marks):
            # A mark is of no more use if all windows it can stand for lie in one settled span.
            width = int(max(stops.max(), marks.max())) + 1
            rank, mark_rank = np.searchsorted(own, keys), np.searchsorted(own, mark_keys)
            at = np.searchsorted(rank * width + starts, mark_rank * width + np.maximum(marks - (window - NAME_WORDS), 0), side="right") - 1
            settled = (at >= 0) & (rank[at] == mark_rank) & (stops[at] > marks - LEFT_CONTEXT)
            mark_keys, marks = mark_keys[~settled], marks[~settled]
        order = np.lexsort((marks, mark_keys))
        return pa.RecordBatch.from_arrays([pa.array(own), _packed(own, mark_keys[order], marks[order]), _lists_of(own, keys, starts), _lists_of(own, keys, stops)], schema=schema)

    return lists


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """``(key, starts, stops)``: the word spans to cut from each document.

    ``docs`` has unique longs ``key``, in the documents' order, and ``text``. A
    span covers windows whose words also start earlier in key and word order.
    """
    def name_batches(batches):
        for batch in batches:
            for chunk, _ in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), window):
                yield from _name_rows(chunk)

    names = docs.select("key", "text").mapInArrow(name_batches, "name long, check int, key long, pos int, size int, more array<struct<key:long,pos:int>>")
    alike = Window.partitionBy("name", "check", "block")
    names = names.withColumn("block", F.signum("size")).withColumn("n", F.count("*").over(alike)).withColumn("r", F.rank().over(alike.orderBy("key", "pos")))
    shared = (F.col("size") == 0) & ((F.col("n") > 1) | F.col("more").isNotNull())
    settled = (F.col("size") < 0) | ((F.col("size") > 0) & (F.col("r") > 1))
    places = F.concat(F.array(F.struct("key", "pos")), F.coalesce("more", F.array().cast("array<struct<key:long,pos:int>>")))
    found = names.where(shared | settled).select(F.explode(places).alias("p"), F.abs("size").alias("size")).select("p.key", "p.pos", "size")
    marks = cut_lineage(found.repartition("key").sortWithinPartitions("key").mapInArrow(_per_key(_mark_lists(window)), "key long, marks binary, starts array<int>, stops array<int>"))
    size = marks.agg(F.sum(F.length("marks") + 8 * F.size("starts") + 64)).first()[0]

    def window_batches(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for chunk, own in _chunks(columns[0], columns[1], window, list(zip(*columns[2:]))):
                yield _window_rows(chunk, own)

    marked = docs.select("key", "text").join(measured(marks.where(F.length("marks") > 0), size), "key").select("key", "text", "marks", "starts", "stops")
    windows = marked.mapInArrow(window_batches, "h1 long, h2 int, key long, start int, stop int")
    order = Window.partitionBy("h1", "h2", F.col("stop") > 0).orderBy("key", "start")
    later = windows.withColumn("r", F.rank().over(order)).where((F.col("r") > 1) | (F.col("stop") > 0))
    spans = later.select("key", "start", F.when(F.col("stop") > 0, F.col("stop")).otherwise(F.col("start") + window).alias("stop"))
    long_spans = marks.select("key", F.explode(F.arrays_zip("starts", "stops")).alias("s")).select("key", F.col("s.starts").alias("start"), (F.col("s.stops") + window - 1).alias("stop"))
    merged = spans.unionByName(long_spans).repartition("key").sortWithinPartitions("key")
    return merged.mapInArrow(_per_key(_span_lists), "key long, starts array<int>, stops array<int>")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: str | None, starts, stops) -> tuple[str | None, int, int, str]:
    """The text without the words of the spans, its words, those cut, the digest of the rest.

    White space goes with the word before it; that at the text's start stays, and
    so does everything else.
    """
    raw = utf8(text)
    words = raw.split()
    if starts is None or not len(starts):
        return text, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    places = [m.span() for m in _WORD.finditer(raw)]
    begins = [b for b, _ in places] + [len(raw)]
    pieces, kept, done = [], [], 0
    for a, b in zip(starts, stops):
        pieces.append(raw[begins[done] if done else 0 : begins[a]])
        kept += words[done:a]
        done = b
    pieces.append(raw[begins[done] :] if done < len(words) else b"")
    kept += words[done:]
    return b"".join(pieces).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


CUT_TYPE = StructType([StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])


@F.pandas_udf(CUT_TYPE)
def _cut(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut_words(t, a, b) for t, a, b in zip(text, starts, stops)], columns=["text", "n_words", "n_removed", "kept_sha256"])


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__key``: the id if it is a key, else the rank of (id, digest of the text), nulls last."""
    if not has_repeats(docs, id_col):
        return docs.withColumn("__key", F.col(id_col).cast("long"))
    digest = F.coalesce(F.md5(text_col), F.lit(""))
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest")).distinct()
    ranked = cut_lineage(with_dense_index(pairs.withColumn("last", F.col("id").isNull()), ["last", "id", "digest"], "__key"))
    ranked = ranked.select("__key", F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    return docs.withColumn("__text_digest", digest).join(ranked, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_digest") == F.col("__digest"))).drop("__id", "__digest", "__text_digest")


def cut_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``__cut`` (text, n_words, n_removed, kept_sha256) added.

    A word goes if it lies in a window of ``window`` words of its document whose
    words also start earlier: in a smaller id, or before in the same document.
    Windows are judged on the input. Null texts have no words and stay null;
    texts shorter than a window are left alone. Ids come before null ids; rows
    that share an id are ordered by the digest of their text, and repeated rows
    (same id and text) count as one, so none of them loses words to its twin.
    All columns of ``docs`` are kept, whatever their names.
    """
    keyed = _with_keys(docs, id_col, text_col)
    spans = cut_lineage(repeated_spans(keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text")), window))
    size = spans.agg(F.sum(8 * F.size("starts") + 64)).first()[0]
    spans = spans.select(F.col("key").alias("__key"), F.col("starts").alias("__starts"), F.col("stops").alias("__stops"))
    joined = keyed.join(measured(spans, size), "__key", "left")
    return joined.withColumn("__cut", _cut(F.col(text_col), "__starts", "__stops")).drop("__key", "__starts", "__stops")
