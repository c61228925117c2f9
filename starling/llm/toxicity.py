"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The features are densities of two lexicons (a fixed list of insults, and words
and word beginnings learned from labelled rows), how close insults stand to a
second-person word, capitals, punctuation and obfuscation rates. Lexicon, trees
and calibration learn from three disjoint parts of a bounded labelled sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.boosting import BoostedTrees, Isotonic
from starling.llm.common import utf8
from starling.llm.labels import held_out, labelled_sample

# At most this many labelled rows of each class are learned from.
ROWS_PER_CLASS = 8000
# Learned lexicon: at most so many entries, each in at least so many toxic texts, so many times likelier there.
LEXICON_SIZE, LEXICON_TEXTS, LEXICON_ODDS = 1000, 3, 6.0
PREFIXES = (4, 5, 6)

INSULTS = frozenset(
    """arsehole ass asshole bastard bitch bollocks bullshit clown coward crap creep cretin cunt degenerate despicable dickhead
    disgusting douche dumb dumbass dunce fool freak fuck fucking garbage hate hideous idiot idiotic ignorant imbecile jerk
    kill liar loser lunatic maggot moron moronic nasty nazi parasite pathetic pig psycho retard retarded scum scumbag shit
    shithead sick slut stupid subhuman sucker swine trash twat ugly useless vermin vile whore worthless wretch
    arschloch dreck dumm dummkopf hure idioten schlampe scheisse scheiße schwein trottel wichser widerlich wertlos
    abruti connard connasse crétin débile imbécile ordure pourriture putain salaud salope stupide
    basura cabrón estúpido estúpida gilipollas idiota imbécil inútil maldito mierda pendejo puta""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
_WORDS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[A-Za-z]+[0-9@$*!]+[A-Za-z][A-Za-z0-9@$*!]*")
_SPACED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z][.\-_*]){2,}[A-Za-z](?![A-Za-z])")
_STRETCHED = re.compile(r"([A-Za-z])\1\1")
_KIND = np.zeros(256, dtype=np.int64)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!", b"?", b"#$%&*+<=>@^_`|~", b"\"'(),-./:;[\\]{}"), start=1):
    _KIND[list(_set)] = _i


def _terms(text: str | None) -> set[str]:
    """Words and marked word beginnings that may enter the lexicon."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log-odds of the terms that mark toxic texts, over rows ``(label, text)``."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(_terms(text))
            terms = list(seen[1] if not seen[0] else seen[1] | seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))], schema=schema)

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    terms = sample.select("label", "text").mapInArrow(counts, "term string, toxic long, clean long")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEXICON_TEXTS)
    odds = ((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("clean") + 0.5) / (clean + 1.0))
    best = terms.withColumn("odds", odds).where(F.col("odds") >= LEXICON_ODDS).orderBy(F.col("toxic") * F.log("odds"), "term", ascending=[False, True]).limit(LEXICON_SIZE)
    return {r["term"]: float(np.log(r["odds"])) for r in best.collect()}


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text, however long; all 0 without words."""
    text = text or ""
    words = _WORDS.findall(text.lower())
    counts = Counter(words)
    known: dict[str, float] = {}
    for word in counts:
        weight = lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                weight = max(weight, lexicon.get(word[:n] + "-", 0.0))
        if weight:
            known[word] = weight
    insults = sum(counts[w] for w in INSULTS & counts.keys())
    learned = sum(counts[w] for w in known)
    addressed = sum(counts[w] for w in SECOND_PERSON & counts.keys())
    near = 0.0
    if addressed and (insults or learned):
        mine = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        theirs = np.array([i for i, w in enumerate(words) if w in INSULTS or w in known])
        after = np.clip(np.searchsorted(mine, theirs), 0, len(mine) - 1)
        gaps = np.minimum(np.abs(theirs - mine[after]), np.abs(theirs - mine[np.maximum(after - 1, 0)]))
        near = 1.0 / max(1.0, float(gaps.min()))
    hidden = [m.translate(LEET).replace("*", "") for m in _MIXED.findall(text.lower())] + [re.sub(r"[.\-_*]", "", m) for m in _SPACED.findall(text.lower())]
    raw = np.bincount(_KIND[np.frombuffer(utf8(text), dtype=np.uint8)], minlength=8) if text else np.zeros(8)
    n, size = max(1, len(words)), max(1, len(text))
    letters = max(1, int(raw[1] + raw[2]))
    weights = sorted(known.values(), reverse=True)
    return [
        np.log1p(len(words)), np.log1p(insults), insults / n, np.log1p(learned), learned / n, weights[0] if weights else 0.0,
        float(sum(w * counts[t] for t, w in known.items())), np.log1p(len(known)), near, addressed / n, raw[1] / letters, raw[3] / n, raw[4] / n,
        raw[5] / size, raw[6] / size, raw[7] / size, len(hidden) / n, float(sum(w in INSULTS or w in known for w in hidden)), len(_STRETCHED.findall(text)) / n,
    ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None
    calibration: Isotonic | None

    def score(self, texts: pd.Series) -> np.ndarray:
        """Probability of label 1 for each text; 0 if nothing could be learned."""
        if self.trees is None or not len(texts):
            return np.zeros(len(texts))
        return self.calibration(self.trees.scores(np.array([features(t, self.lexicon) for t in texts])))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``rows_per_class`` labelled rows of each class outside the held-out fold.

    Without labelled rows of both classes the model scores everything 0.
    """
    sample, weights = labelled_sample(docs, labels, "toxic", rows_per_class, id_col, text_col)
    part = F.pmod(F.hash("u"), F.lit(3))
    lexicon = learn_lexicon(sample.where(part == 0))
    schema = "part int, label int, x array<double>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "label": b["label"], "x": [features(t, lexicon) for t in b["text"]]})

    measured = sample.select(part.alias("part"), "label", "text", "u").where("part > 0").orderBy("u").drop("u").mapInPandas(rows, schema).toPandas()
    if measured.groupby("part")["label"].nunique().tolist() != [2, 2]:
        return ToxicityModel(lexicon, None, None)
    parts = {}
    for p in (1, 2):
        own = measured[measured["part"] == p]
        y = own["label"].to_numpy(dtype=float)
        parts[p] = np.array(own["x"].tolist()), y, np.where(y > 0, weights[1], weights[0])
    trees = BoostedTrees().fit(*parts[1])
    x, y, weight = parts[2]
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.scores(x), y, weight))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the model's score of every whole text. Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text), dtype=float)

    return docs.withColumn(name, score(F.col(text_col)))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; repeated rows score alike, null ids count as not held out."""
    rows = with_toxicity(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, "score")
    return rows.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
