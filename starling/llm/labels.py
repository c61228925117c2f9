"""Bounded labelled samples for fitting classifiers, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.session import cut_lineage

FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Rows no classifier learns from: crc32 of the id as text is divisible by ``FOLDS``. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """``(u, label, text)`` of at most ``per_class`` labelled rows of each class, and what each class's rows weigh.

    Rows are those with the smallest hash of their id, so the sample does not
    depend on the partitioning; ``u`` is that hash, for splits. The weights
    restore the classes' true shares. Held-out ids, null ids and null labels
    take no part; of contradicting labels the larger counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("sample_id")).agg(F.max(F.col(target).cast("int")).alias("label"))
    known = cut_lineage(known.withColumn("u", F.pmod(F.xxhash64(F.lit(target), "sample_id"), F.lit(1 << 30))))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = known.limit(0)
    for label in (0, 1):
        picked = picked.unionByName(known.where(F.col("label") == label).orderBy("u", "sample_id").limit(per_class))
    picked = cut_lineage(picked)
    texts = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), F.col("text_id") == F.col("sample_id"))
    weights = {k: counts.get(k, 0) / max(1, min(per_class, counts.get(k, 0))) for k in (0, 1)}
    return cut_lineage(sample.select("u", "label", "text")), weights
