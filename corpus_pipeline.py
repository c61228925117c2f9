"""Documents to a training mix: toxicity, near-duplicates, repeated passages, benchmark leaks, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.llm import decontaminate, mixing, simhash, substrings, toxicity
from starling.llm.common import read, short_batches
from starling.session import cut_lineage


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; the model learns from the labelled ones among them."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, model, name="__toxicity").where(F.col("__toxicity") < 0.5).drop("__toxicity")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints at three bits or fewer."""
    short_batches(spark)
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier; ``n_chars`` counts what is left."""
    short_batches(spark)
    cut = substrings.cut_repeats(docs)
    names = {"text": F.col("__cut.text"), "n_chars": F.length("__cut.text").cast("long")}
    return cut.select(*(names[c].alias(c) if c in names else F.col(c) for c in docs.columns))


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, with the epoch and the block's rank in it."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("source_mixing", mix_sources),
]

# The toxicity model cannot be said in SQL; tests compare every other stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
