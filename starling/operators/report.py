"""The tables behind cluster plots and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.functions.vectors import hash_uniform
from starling.operators.moments import group_moments
from starling.operators.prepare import width

NOISE = -1


def display_name(cluster: Column) -> Column:
    return F.when(cluster == NOISE, "Noise").otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))


def size_distribution(labelled: DataFrame) -> DataFrame:
    """Rows per cluster, noise named apart."""
    return labelled.groupBy("cluster").agg(F.count("*").alias("size")).select(
        "cluster", display_name(F.col("cluster")).alias("name"), "size"
    )


def cluster_report(labelled: DataFrame) -> DataFrame:
    """Per cluster: name, size, percent, centre and population std arrays."""
    moments = group_moments(labelled)
    total = labelled.count()
    return moments.select(
        F.when(F.col("cluster") == NOISE, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).alias("name"),
        "cluster",
        F.col("n").alias("size"),
        (F.col("n") * 100.0 / F.lit(total)).alias("percent"),
        "center",
        "std",
    )


def report_long(report: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """The report with one row per cluster and feature."""
    name = F.array(*[F.lit(f) for f in features]) if features else None
    feature = F.element_at(name, F.col("position") + 1) if features else F.concat(F.lit("feature_"), F.col("position"))
    return (
        report.select("name", "cluster", "size", "percent", F.posexplode(F.arrays_zip("center", "std")).alias("position", "v"))
        .select("name", "cluster", "size", "percent", "position", feature.alias("feature"), F.col("v.center").alias("center"), F.col("v.std").alias("std"))
    )


def report_summary(labelled: DataFrame, algorithm: str, metrics: dict) -> dict:
    """Headline numbers of a run, in the shape of a report's summary block."""
    return {
        "algorithm": algorithm,
        "total_samples": metrics["n_samples"],
        "features": width(labelled),
        "clusters_found": metrics["n_labels"],
        "noise_points": metrics["n_noise"],
        "quality_score": metrics["silhouette_score"],
    }


def centroid_heatmap(labelled: DataFrame, features: Sequence[str], top: int = 50) -> DataFrame:
    """Centroid value per cluster and feature, noise left out.

    With more than ``top`` features only those that vary most across the
    centroids stay (ties: the later feature, as an ascending sort's tail).
    """
    clusters = labelled.where(F.col("cluster") != NOISE)
    names = F.array(*[F.lit(f) for f in features])
    cells = group_moments(clusters, dims=len(features)).select(
        "cluster", F.posexplode("center").alias("position", "value")
    )
    if len(features) > top:
        keep = (
            cells.groupBy("position").agg(F.var_pop("value").alias("spread"))
            .orderBy(F.desc("spread"), F.desc("position")).limit(top).select("position")
        )
        cells = cells.join(F.broadcast(keep), "position", "left_semi")
    return cells.select(
        "cluster", display_name(F.col("cluster")).alias("name"), "position",
        F.element_at(names, F.col("position") + 1).alias("feature"), "value",
    )


def feature_importance(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of each feature's variance that lies between the clusters."""
    moments = group_moments(labelled, dims=len(features)).select(
        "n", F.posexplode(F.arrays_zip("center", "std")).alias("position", "v")
    )
    n, mean, std = F.col("n"), F.col("v.center"), F.col("v.std")
    # One row per feature, so the width of the table bounds it.
    grand = moments.groupBy("position").agg((F.sum(n * mean) / F.sum(n)).alias("grand"))
    gap = mean - F.col("grand")
    sums = moments.join(F.broadcast(grand), "position").withColumns({"_between": n * gap * gap, "_within": n * std * std})
    names = F.array(*[F.lit(f) for f in features])
    total = F.sum("_between") + F.sum("_within")
    return sums.groupBy("position").agg(
        F.when(total > 0, F.sum("_between") / total).otherwise(0.0).alias("importance")
    ).select(F.element_at(names, F.col("position") + 1).alias("feature"), "importance")


def top_importance(importances: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` features of ``(feature, importance)``, best first."""
    return importances.orderBy(F.desc("importance"), "feature").limit(top)


def scatter_frame(
    labelled: DataFrame, coordinates: DataFrame | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """``(row_id, x, y, cluster)``: the first two features, or given coordinates.

    ``coordinates`` is a ``(row_id, features)`` frame such as a 2-D projection.
    ``fraction`` draws a sample for tables too long to plot.
    """
    if fraction is not None:
        labelled = labelled.where(hash_uniform(seed, F.col("row_id"), F.lit("scatter")) < fraction)
    if coordinates is not None:
        labelled = labelled.select("row_id", "cluster").join(coordinates.select("row_id", "features"), "row_id")
    x = F.col("features")
    return labelled.select("row_id", x[0].alias("x"), x[1].alias("y"), "cluster")


def compare_algorithms(results: DataFrame, metric: str) -> DataFrame:
    """One metric per run of ``(algorithm, metrics map)``; a missing one counts 0."""
    return results.select("algorithm", F.coalesce(F.try_element_at("metrics", F.lit(metric)), F.lit(0.0)).alias(metric))


def experiment_history(experiments: DataFrame) -> DataFrame:
    """id, algorithm, status, clusters, score, date as shown in a history list."""
    done = F.col("status") == "completed"
    metric = lambda name: F.try_element_at("metrics", F.lit(name))
    return experiments.select(
        "id",
        F.coalesce("algorithm", F.lit("unknown")).alias("algorithm"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.when(done, metric("n_clusters").cast("long")).alias("clusters"),
        F.when(done, F.round(F.coalesce(metric("silhouette_score"), F.lit(0.0)), 3)).alias("score"),
        F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("date"),
    )


def status_counts(experiments: DataFrame) -> DataFrame:
    """One row: total, completed, failed, running."""
    status = F.col("status")
    return experiments.agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("completed", "failed", "running")],
    )


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 10, offset: int = 0) -> tuple[DataFrame, int]:
    """One page in ``order`` and the total number of rows."""
    return df.orderBy(*order).offset(offset).limit(limit), df.count()
