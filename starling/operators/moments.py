"""Per-group counts, means and spreads of a feature frame, in one aggregate."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.operators.prepare import width

# Up to this width every dimension is its own aggregate and compiles to code.
UNROLL = 64


def group_moments(ff: DataFrame, by: str = "cluster", dims: int | None = None) -> DataFrame:
    """``(by, n, center array, std array (population))`` per group.

    Partial aggregates run before the shuffle, so one group holding most of
    the rows still moves one row per task.
    """
    dims = width(ff) if dims is None else dims
    x = F.col("features")
    if dims <= UNROLL:
        return ff.groupBy(by).agg(
            F.count("*").alias("n"),
            F.array(*[F.avg(x[j]) for j in range(dims)]).alias("center"),
            F.array(*[F.stddev_pop(x[j]) for j in range(dims)]).alias("std"),
        )
    summary = ff.groupBy(by).agg(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features")).alias("s"))
    shrink = (F.col("s.count") - 1) / F.col("s.count")
    return summary.select(
        by,
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("center"),
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * shrink)).alias("std"),
    )


def within_squares(moments: DataFrame) -> DataFrame:
    """Add ``ss``: the group's sum of squared distances to its own mean."""
    return moments.withColumn("ss", F.col("n") * F.aggregate("std", F.lit(0.0), lambda acc, s: acc + s * s))


def group_boxes(points: DataFrame, by: list[str], dims: int, *extra) -> DataFrame:
    """Bounding box ``lo, hi`` (arrays) per group, with further aggregates."""
    x = F.col("features")
    if dims <= UNROLL:
        return points.groupBy(*by).agg(
            F.array(*[F.min(x[j]) for j in range(dims)]).alias("lo"),
            F.array(*[F.max(x[j]) for j in range(dims)]).alias("hi"),
            *extra,
        )
    boxed = points.groupBy(*by).agg(Summarizer.metrics("min", "max").summary(array_to_vector("features")).alias("s"), *extra)
    return boxed.withColumns({"lo": vector_to_array("s.min"), "hi": vector_to_array("s.max")}).drop("s")
