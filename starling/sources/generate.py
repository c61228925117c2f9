"""Synthetic data sets, generated in parallel from hashed row ids.

Every number hangs on (row id, position, seed) only, so a row comes out the
same under any partitioning and after any retry. ``ids`` is a row count or a
frame with a ``row_id`` column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions.vectors import hash_normal, hash_uniform, row_summary
from starling.operators.scale import fit_scaler

# Means and spread of the three sample clusters, and the limits
# of the rules that label the mixed data set.
THREE_MEANS = ((2.0, 2.0), (6.0, 6.0), (2.0, 6.0))
THREE_STD = 0.8
MIXED_RULES = ((0, ">", 1.0, 0), (1, ">", 0.5, 1), (2, "<", -0.5, 2))
MIXED_ELSE = 3
CENTER_BOX = 10.0


def _ids(spark: SparkSession, ids: DataFrame | int) -> DataFrame:
    if isinstance(ids, int):
        return spark.range(ids).select(F.col("id").alias("row_id"))
    # Ids are few bytes and would stay in few tasks, while a row takes many hashes.
    return ids.select("row_id").repartition(2 * spark.sparkContext.defaultParallelism)


def _positions(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _label(groups: int, seed: int) -> Column:
    return F.floor(hash_uniform(seed, F.col("row_id"), F.lit("label")) * groups).cast("int")


def widen(frame: DataFrame, names: Sequence[str], column: str = "features") -> DataFrame:
    """Spread an array column over named columns."""
    return frame.select(*[c for c in frame.columns if c != column], *[F.col(column)[j].alias(n) for j, n in enumerate(names)])


def gen_blobs(
    spark: SparkSession, ids: DataFrame | int, d: int, k: int, std: float = 1.0, noise_dims: int = 0,
    noise_std: float = 1.0, missing_rate: float = 0.0, seed: int = 42,
) -> DataFrame:
    """Gaussian blobs around k random centres, then pure-noise features.

    ``(row_id, features, true_label)``; missing values are NULL elements.
    """
    key = F.col("row_id")
    frame = _ids(spark, ids).withColumn("true_label", _label(k, seed))
    centre = lambda j: (hash_uniform(seed, F.lit("center"), F.col("true_label"), j) * 2.0 - 1.0) * CENTER_BOX
    values = F.transform(_positions(d), lambda j: centre(j) + F.lit(std) * hash_normal(seed, key, j))
    if noise_dims:
        noise = F.transform(_positions(noise_dims), lambda j: F.lit(noise_std) * hash_normal(seed, key, j + d))
        values = F.concat(values, noise)
    if missing_rate:
        values = _with_gaps(values, missing_rate, seed)
    return frame.select("row_id", values.alias("features"), "true_label")


def _with_gaps(values: Column, rate: float, seed: int) -> Column:
    gap = lambda j: hash_uniform(seed, F.col("row_id"), F.lit("gap"), j) < rate
    return F.transform(values, lambda x, j: F.when(~gap(j), x))


def gen_three_clusters(spark: SparkSession, ids: DataFrame | int, seed: int = 42) -> DataFrame:
    """Two cluster dimensions, their sum and product with noise, one noise feature."""
    key = F.col("row_id")
    normal = lambda j: hash_normal(seed, key, F.lit(j))
    mean = lambda axis: F.element_at(F.array(*[F.lit(m[axis]) for m in THREE_MEANS]), F.col("true_label") + 1)
    frame = _ids(spark, ids).withColumn("true_label", _label(len(THREE_MEANS), seed))
    frame = frame.withColumn("feature_1", mean(0) + F.lit(THREE_STD) * normal(0)).withColumn("feature_2", mean(1) + F.lit(THREE_STD) * normal(1))
    return frame.select(
        "row_id", "feature_1", "feature_2",
        (F.col("feature_1") + F.col("feature_2") + 0.1 * normal(2)).alias("feature_3"),
        (F.col("feature_1") * F.col("feature_2") + 0.5 * normal(3)).alias("feature_4"),
        normal(4).alias("feature_5"),
        "true_label",
    )


def gen_classification(
    spark: SparkSession, ids: DataFrame | int, d: int, informative: int, redundant: int, classes: int,
    separation: float = 1.0, seed: int = 42,
) -> DataFrame:
    """Classes on hypercube corners, mixtures of those features, then noise."""
    key = F.col("row_id")
    frame = _ids(spark, ids).withColumn("true_label", _label(classes, seed))
    corner = lambda j: F.when(hash_uniform(seed, F.lit("corner"), F.col("true_label"), j) < 0.5, -separation).otherwise(separation)
    frame = frame.withColumn("_inf", F.transform(_positions(informative), lambda j: corner(j) + hash_normal(seed, key, j)))
    parts = [F.col("_inf")]
    if redundant:
        weight = lambda r, i: hash_uniform(seed, F.lit("mix"), r, i) * 2.0 - 1.0
        mixed = lambda r: F.aggregate(F.transform("_inf", lambda x, i: x * weight(r, i)), F.lit(0.0), lambda acc, x: acc + x)
        parts.append(F.transform(_positions(redundant), mixed))
    rest = d - informative - redundant
    if rest > 0:
        parts.append(F.transform(_positions(rest), lambda j: hash_normal(seed, key, j + informative)))
    return frame.select("row_id", F.concat(*parts).alias("features"), "true_label")


def gen_mixed(
    spark: SparkSession, ids: DataFrame | int, numeric: int = 80, categorical: int = 10, binary: int = 20,
    missing_rate: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Normal, 0..4 and 0/1 features with gaps; labels from rules on the first
    three standardised features."""
    key = F.col("row_id")
    picks = lambda n, levels, at: F.transform(
        _positions(n), lambda j: F.floor(hash_uniform(seed, key, j + at) * levels).cast("double")
    )
    parts = [F.transform(_positions(numeric), lambda j: hash_normal(seed, key, j))]
    if categorical:
        parts.append(picks(categorical, 5, numeric))
    if binary:
        parts.append(picks(binary, 2, numeric + categorical))
    frame = _ids(spark, ids).withColumn("features", F.concat(*parts))
    heads = [f"_x{i}" for i, *_ in MIXED_RULES]
    frame = frame.withColumns({h: F.col("features")[i] for h, (i, *_) in zip(heads, MIXED_RULES)})
    frame = fit_scaler(frame, heads).transform(frame)
    rule = None
    for h, (_, sign, limit, label) in zip(heads, MIXED_RULES):
        hit = F.col(h) > limit if sign == ">" else F.col(h) < limit
        rule = F.when(hit, label) if rule is None else rule.when(hit, label)
    values = _with_gaps(F.col("features"), missing_rate, seed) if missing_rate else F.col("features")
    return frame.select("row_id", values.alias("features"), rule.otherwise(MIXED_ELSE).alias("true_label"))


def gen_timeseries(spark: SparkSession, ids: DataFrame | int, steps: int = 50, seed: int = 42) -> DataFrame:
    """Trend, sine, decay or random walk per row, with the row's summary features."""
    key = F.col("row_id")
    frame = _ids(spark, ids).withColumn("true_label", _label(4, seed))
    frame = frame.withColumn("_noise", F.transform(_positions(steps), lambda j: hash_normal(seed, key, j)))
    at = lambda t, stop: t * F.lit(stop / (steps - 1))
    walk = F.aggregate(
        F.slice("_noise", 2, steps), F.array(F.lit(0.0) + F.col("_noise")[0] * 0.1),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x * 0.1)),
    )
    label = F.col("true_label")
    series = (
        F.when(label == 0, F.transform("_noise", lambda e, t: at(t, 10.0) + e * 0.5))
        .when(label == 1, F.transform("_noise", lambda e, t: F.sin(at(t, 4 * math.pi)) + e * 0.3))
        .when(label == 2, F.transform("_noise", lambda e, t: F.exp(-at(t, 3.0)) + e * 0.2))
        .otherwise(walk)
    )
    frame = frame.select("row_id", series.alias("series"), "true_label")
    return frame.select("row_id", "series", *row_summary(F.col("series")), "true_label")
