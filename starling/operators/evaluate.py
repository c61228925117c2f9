"""Clustering scores over a labelled feature frame ``(row_id, features, cluster)``."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.functions.blocks import block_pairs, distances, large_blocks
from starling.functions.ranks import with_dense_index
from starling.functions.sampling import broadcast_if_small, hash_sample
from starling.functions.vectors import squared_distance_dims
from starling.operators.kmeans import assign, centers_frame, fit_each_k
from starling.operators.moments import group_moments, within_squares
from starling.operators.prepare import width
from starling.session import cut_lineage

NOISE = -1
NOISE_POLICIES = ("drop", "skip", "as_cluster")
SAMPLE_VALUES = 2_000_000
MAX_BATCH_ROWS = 4096
# Rows of two blocks whose distances are held at a time, so that they stay in a core's cache.
TILE = (128, 1024)


def label_counts(labelled: DataFrame) -> DataFrame:
    """One row: n_samples, n_clusters (noise apart), n_labels, n_noise, noise_ratio."""
    # Counted per label first, so the distinct count never sees a raw row.
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.sum("n").alias("n_samples"),
        F.count_if(F.col("cluster") != NOISE).alias("n_clusters"),
        F.count("*").alias("n_labels"),
        noise.alias("n_noise"),
        (noise / F.sum("n")).alias("noise_ratio"),
    )


def silhouette_rows(labelled: DataFrame) -> DataFrame:
    """``(row_id, cluster, a, b, silhouette)`` per row, Euclidean and exact.

    Every pair of distinct points counts, so the work is quadratic in the
    distinct points; copies of a point are weighed, not compared. Singletons
    score 0, and with fewer than two labels a, b and the score are NULL.
    """
    # A point with copies becomes one weighted row before anything is paired.
    points = _weighted_points(labelled)
    point_scores = _point_silhouettes(points)
    return labelled.select("row_id", "features", "cluster").join(
        points.select("features", "cluster", F.col("row_id").alias("point")), ["features", "cluster"]
    ).join(point_scores.withColumnRenamed("row_id", "point"), "point", "left").select(
        "row_id", "cluster", "a", "b", "silhouette"
    )


def _weighted_points(labelled: DataFrame) -> DataFrame:
    return cut_lineage(labelled.groupBy("features", "cluster").agg(
        F.min("row_id").alias("row_id"), F.count("*").cast("double").alias("weight")
    ))


def _distance_sums(left, right):
    """Weighted distance sums of the left rows to each label in the right block."""
    order = np.argsort(right["cluster"], kind="stable")
    labels, starts = np.unique(right["cluster"][order], return_index=True)
    gaps = distances(left["features"], right["features"][order]) * right["weight"][order]
    sums = np.add.reduceat(gaps, starts, axis=1)
    return pd.DataFrame({
        "row_id": np.repeat(left["row_id"], len(labels)),
        "label": np.tile(labels, len(left["row_id"])),
        "total": sums.ravel(),
    })


def _scores_from_sums(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b and score per row from distance totals ``(row_id, cluster, label, total)``."""
    own = F.col("cluster") == F.col("label")
    per_row = (
        sums.join(sizes.select(F.col("cluster").alias("label"), F.col("n").alias("size")), "label")
        .groupBy("row_id", "cluster")
        .agg(
            F.max(F.when(own, F.col("size"))).alias("own"),
            F.sum(F.when(own, F.col("total"))).alias("own_total"),
            F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
        )
    )
    a = F.when(F.col("own") > 1, F.col("own_total") / (F.col("own") - 1)).otherwise(0.0)
    widest = F.greatest("a", "b")
    score = (
        F.when(F.col("b").isNull(), None)
        .when((F.col("own") <= 1) | (widest == 0.0), 0.0)
        .otherwise((F.col("b") - F.col("a")) / widest)
    )
    return per_row.withColumn("a", a).withColumn("silhouette", score).select("row_id", "a", "b", "silhouette")


def _point_silhouettes(points: DataFrame) -> DataFrame:
    id_type = points.schema["row_id"].dataType.simpleString()
    partial = block_pairs(
        points.select("row_id", "features"), points, _distance_sums, f"row_id {id_type}, label int, total double"
    )
    totals = partial.groupBy("row_id", "label").agg(F.sum("total").alias("total"))
    sizes = broadcast_if_small(points.groupBy("cluster").agg(F.sum("weight").alias("n")), 2)
    return _scores_from_sums(totals.join(points.select("row_id", "cluster"), "row_id"), sizes)


def silhouette(labelled: DataFrame, mode: str = "exact", sample_rows: int = 1000, seed: int = 42) -> float | None:
    """Mean Euclidean silhouette.

    ``exact``   every row; quadratic in the distinct points.
    ``sampled`` mean over ``sample_rows`` hash-chosen rows, each scored exactly
                against all rows; linear, for tables too long for ``exact``.
    ``squared`` Spark's own evaluator; squared distances, a different number.
    """
    if mode == "squared":
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.functions import array_to_vector

        frame = labelled.select(array_to_vector("features").alias("features"), F.col("cluster").alias("prediction"))
        return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(frame)
    if mode == "sampled":
        return _sampled_silhouette(labelled, sample_rows, seed)
    if mode != "exact":
        raise ValueError(f"Unknown silhouette mode: {mode}")
    points = _weighted_points(labelled)
    scored = _point_silhouettes(points).join(points.select("row_id", "weight"), "row_id")
    return scored.agg((F.sum(F.col("silhouette") * F.col("weight")) / F.sum("weight")).alias("s")).first()["s"]


def _sampled_silhouette(labelled: DataFrame, sample_rows: int, seed: int) -> float | None:
    dims = width(labelled)
    if not 1 <= sample_rows <= max(1, SAMPLE_VALUES // dims):
        raise ValueError(f"sample_rows must lie in 1..{SAMPLE_VALUES // dims} for {dims} features")
    chosen = hash_sample(labelled.select("row_id", "features", "cluster"), sample_rows, seed=seed)
    spark = labelled.sparkSession
    # Bounded by sample_rows x dims <= SAMPLE_VALUES numbers.
    picked = spark.sparkContext.broadcast(np.array([r["features"] for r in chosen], dtype=float))

    def partial(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                values, labels = np.stack(batch["features"].to_numpy()), batch["cluster"].to_numpy()
                for label in np.unique(labels):
                    part = distances(picked.value, values[labels == label]).sum(axis=1)
                    totals[label] = totals[label] + part if label in totals else part
        for label, part in totals.items():
            yield pd.DataFrame({"pick": np.arange(len(part)), "label": label, "total": part})

    sums = labelled.select("features", "cluster").mapInPandas(partial, "pick int, label int, total double")
    totals = sums.groupBy("pick", "label").agg(F.sum("total").alias("total"))
    labels = spark.createDataFrame([(i, r["cluster"]) for i, r in enumerate(chosen)], "pick int, cluster int")
    sizes = broadcast_if_small(cut_lineage(labelled.groupBy("cluster").agg(F.count("*").alias("n"))), 2)
    scored = _scores_from_sums(totals.join(labels, "pick").withColumnRenamed("pick", "row_id"), sizes)
    return scored.agg(F.avg("silhouette").alias("s")).first()["s"]


def _moment_table(labelled: DataFrame) -> tuple[DataFrame, int]:
    dims = width(labelled)
    return within_squares(group_moments(labelled, dims=dims)), dims


def calinski_harabasz(labelled: DataFrame) -> float | None:
    """Between/within dispersion ratio from one per-cluster aggregate."""
    table, dims = _moment_table(labelled)
    table = table.persist()
    try:
        c, n = F.col("center"), F.col("n")
        head = table.agg(
            F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("within"),
            F.array(*[F.sum(n * c[j]) / F.sum("n") for j in range(dims)]).alias("mean"),
        ).first()
        if head["k"] < 2 or head["k"] >= head["n"]:
            return None
        mean = F.array(*[F.lit(x) for x in head["mean"]])
        between = table.agg(F.sum(n * squared_distance_dims(c, mean, dims)).alias("b")).first()["b"]
    finally:
        table.unpersist()
    if head["within"] == 0.0:
        return 1.0
    return between * (head["n"] - head["k"]) / (head["within"] * (head["k"] - 1))


def davies_bouldin(labelled: DataFrame) -> float | None:
    """Mean over clusters of the worst (spread_i + spread_j) / centre distance."""
    table, dims = _moment_table(labelled)
    table, spreads = table.persist(), None
    try:
        gap = F.sqrt(squared_distance_dims(F.col("features"), F.col("center"), dims))
        centers = broadcast_if_small(table.select("cluster", "center"), dims)
        spreads = (
            labelled.select("features", "cluster").join(centers, "cluster")
            .groupBy("cluster").agg(F.avg(gap).alias("spread"))
            .join(table.select("cluster", "center"), "cluster")
            .select(F.col("cluster").alias("row_id"), F.col("center").alias("features"), "spread")
        ).persist()
        n_labels = spreads.count()
        if n_labels < 2 or n_labels >= table.agg(F.sum("n")).first()[0]:
            return None

        def worst(left, right):
            apart = distances(left["features"], right["features"])
            same = left["row_id"][:, None] == right["row_id"][None, :]
            apart[same | (apart == 0.0)] = np.inf
            ratio = (left["spread"][:, None] + right["spread"][None, :]) / apart
            return pd.DataFrame({"row_id": left["row_id"], "worst": ratio.max(axis=1)})

        ratios = block_pairs(spreads, spreads, worst, "row_id int, worst double")
        return ratios.groupBy("row_id").agg(F.max("worst").alias("w")).agg(F.avg("w").alias("s")).first()["s"]
    finally:
        table.unpersist()
        if spreads is not None:
            spreads.unpersist()


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def _xlogx(n: Column) -> Column:
    return n * F.ln(n.cast("double"))


def label_agreement(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """One row: adjusted_rand, normalized_mutual_info (arithmetic mean).

    Both scores need only sums over the contingency cells, its margins and the
    total, so one small cube over the counted cells gives everything.
    """
    cells = df.groupBy(F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count("*").alias("n"))
    levels = cells.cube("t", "p").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))

    def at(level, value):
        return F.sum(F.when(F.col("level") == level, value))

    n = F.col("n")
    sums = levels.agg(
        at(3, n).alias("n"),
        at(0, _pairs(n)).alias("cell_pairs"), at(1, _pairs(n)).alias("true_pairs"),
        at(2, _pairs(n)).alias("pred_pairs"), at(3, _pairs(n)).alias("all_pairs"),
        at(0, _xlogx(n)).alias("cell_log"), at(1, _xlogx(n)).alias("true_log"),
        at(2, _xlogx(n)).alias("pred_log"), at(3, _xlogx(n)).alias("all_log"),
    )
    expected = F.col("true_pairs") * F.col("pred_pairs") / F.col("all_pairs")
    best = (F.col("true_pairs") + F.col("pred_pairs")) / 2
    mutual = (F.col("cell_log") - F.col("true_log") - F.col("pred_log") + F.col("all_log")) / F.col("n")
    entropy_true = (F.col("all_log") - F.col("true_log")) / F.col("n")
    entropy_pred = (F.col("all_log") - F.col("pred_log")) / F.col("n")
    mean_entropy = (entropy_true + entropy_pred) / 2
    return sums.select(
        F.when((F.col("all_pairs") == 0) | (best == expected), 1.0)
        .otherwise((F.col("cell_pairs") - expected) / (best - expected)).alias("adjusted_rand"),
        F.when(mean_entropy <= 1e-15, 1.0).otherwise(mutual / mean_entropy).alias("normalized_mutual_info"),
    )


def adjusted_rand(df: DataFrame, true_col: str, pred_col: str) -> float:
    return label_agreement(df, true_col, pred_col).first()["adjusted_rand"]


def normalized_mutual_info(df: DataFrame, true_col: str, pred_col: str) -> float:
    return label_agreement(df, true_col, pred_col).first()["normalized_mutual_info"]


# Fixed values reported for undefined scores in compatibility mode.
COMPAT_UNDEFINED = {"silhouette_score": -1.0, "calinski_harabasz_score": 0.0, "davies_bouldin_score": float("inf")}


def calculate_metrics(
    labelled: DataFrame, noise: str = "drop", compat: bool = False, silhouette_mode: str = "exact", sample_rows: int = 1000
) -> dict[str, float | int | None]:
    """Counts and scores under a noise policy; undefined scores are None."""
    if noise not in NOISE_POLICIES:
        raise ValueError(f"Unknown noise policy: {noise}")
    frame = labelled.select("row_id", "features", F.col("cluster").cast("int").alias("cluster")).persist()
    try:
        metrics: dict[str, float | int | None] = label_counts(frame).first().asDict()
        scored = frame.where(F.col("cluster") != NOISE) if noise == "drop" else frame
        groups = metrics["n_labels"] if noise == "as_cluster" else metrics["n_clusters"]
        names = list(COMPAT_UNDEFINED)
        metrics.update(dict.fromkeys(names))
        if groups >= 2 and not (noise == "skip" and metrics["n_noise"]):
            metrics["silhouette_score"] = silhouette(scored, silhouette_mode, sample_rows)
            metrics["calinski_harabasz_score"] = calinski_harabasz(scored)
            metrics["davies_bouldin_score"] = davies_bouldin(scored)
    finally:
        frame.unpersist()
    if compat:
        metrics.update({k: v for k, v in COMPAT_UNDEFINED.items() if metrics[k] is None})
    return metrics


def evaluate_model(ff: DataFrame, centers: DataFrame, true_col: str | None = None) -> dict[str, float | int | None]:
    """Score stored centres on new rows, against true labels when given."""
    labelled = assign(ff, centers).persist()
    try:
        counts = label_counts(labelled).first()
        metrics = {"n_clusters": counts["n_clusters"], "silhouette_score": None}
        if counts["n_clusters"] > 1:
            metrics["silhouette_score"] = silhouette(labelled)
        if true_col is not None:
            agreement = label_agreement(labelled, true_col, "cluster").first()
            metrics["adjusted_rand_score"] = agreement["adjusted_rand"]
            metrics["normalized_mutual_info"] = agreement["normalized_mutual_info"]
    finally:
        labelled.unpersist()
    return metrics


def elbow_scores(
    ff: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42, silhouette_mode: str = "exact", sample_rows: int = 1000
) -> DataFrame:
    """``(k, inertia, silhouette)`` per k, the k-means fits sharing their passes."""
    fits = fit_each_k(ff, ks, n_init=n_init, seed=seed)
    if silhouette_mode == "exact":
        scores = _shared_silhouettes(ff, [np.array(points) for _, points, _ in fits.values()])
    else:
        scores = []
        for _, points, _ in fits.values():
            labelled = assign(ff.select("row_id", "features"), centers_frame(ff.sparkSession, points))
            scores.append(silhouette(labelled, silhouette_mode, sample_rows))
    rows = [(k, cost, score) for (k, (cost, _, _)), score in zip(fits.items(), scores)]
    return ff.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def _label_totals(x: np.ndarray, right: dict[str, np.ndarray], starts: np.ndarray, totals: np.ndarray) -> None:
    """Add the weighted distances of ``x`` to the right rows, per label of every labelling, to ``totals``."""
    labels = right["labels"]
    order = np.lexsort(labels.T)
    y, weight, labels = right["features"][order], right["weight"][order], labels[order]
    for beside in range(0, len(y), TILE[1]):
        near, own, tuples = y[beside : beside + TILE[1]], weight[beside : beside + TILE[1]], labels[beside : beside + TILE[1]]
        # Rows that share all their labels are added up once for all labellings.
        cells = np.flatnonzero(np.r_[True, (tuples[1:] != tuples[:-1]).any(axis=1)])
        member = np.zeros((len(cells), totals.shape[1]))
        member[np.arange(len(cells))[:, None], tuples[cells] + starts] = 1.0
        for at in range(0, len(x), TILE[0]):
            gaps = distances(x[at : at + TILE[0]], near)
            gaps *= own
            totals[at : at + TILE[0]] += np.add.reduceat(gaps, cells, axis=1) @ member


def _shared_silhouettes(ff: DataFrame, centers: list[np.ndarray]) -> list[float | None]:
    """Mean exact silhouette of each labelling by nearest centre; all labellings share the distances.

    Quadratic in the distinct points. A task holds one block of points with its totals
    and meets all the others in turn, so only one sum per labelling leaves it.
    """
    points = ff.groupBy("features").agg(F.min("row_id").alias("row_id"), F.count("*").cast("double").alias("weight"))

    @F.pandas_udf("array<int>")
    def nearest(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy())
        found = np.empty((len(x), len(centers)), dtype=np.int32)
        for i, center in enumerate(centers):
            step = max(1, 1_000_000 // len(center))
            for at in range(0, len(x), step):
                found[at : at + step, i] = distances(x[at : at + step], center, squared=True).argmin(axis=1)
        return pd.Series(list(found))

    points = cut_lineage(points.withColumn("labels", nearest("features")))
    starts = np.concatenate([[0], np.cumsum([len(c) for c in centers])]).astype(int)
    sizes = np.zeros(starts[-1])
    for r in points.select("weight", F.posexplode("labels").alias("at", "label")).groupBy("at", "label").agg(F.sum("weight").alias("n")).collect():
        sizes[starts[r["at"]] + r["label"]] = r["n"]
    blocks = math.ceil(points.count() / large_blocks(points.count(), len(centers[0][0]) + len(centers)))
    blocks = max(blocks, min(points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / MAX_BATCH_ROWS)), 1)
    block = F.pmod(F.xxhash64("features"), F.lit(blocks)).cast("int")
    packed = cut_lineage(points.groupBy(block.alias("l")).agg(
        F.flatten(F.collect_list("features")).alias("features"), F.collect_list("weight").alias("weight"), F.flatten(F.collect_list("labels")).alias("labels")
    ))
    rights = packed.select("l", *[F.col(c).alias(f"r_{c}") for c in ("features", "weight", "labels")]).withColumnRenamed("l", "r")
    rights = rights.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # A block itself comes first, as partner -1.
    lefts = packed.withColumn("r", F.lit(-1)).select("l", "r", "features", "weight", "labels")
    rows = rights.select("l", "r", *[F.col(f"r_{c}").alias(c) for c in ("features", "weight", "labels")]).unionByName(lefts)

    def read(row: pd.Series) -> dict[str, np.ndarray]:
        weight = np.asarray(row["weight"], dtype=float)
        return {
            "features": np.asarray(row["features"], dtype=float).reshape(len(weight), -1), "weight": weight,
            "labels": np.asarray(row["labels"], dtype=np.int64).reshape(len(weight), -1),
        }

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        left, totals = None, None
        for row in parts:
            if row["r"] < 0:
                left = read(row)
                totals = np.zeros((len(left["weight"]), starts[-1]))
            elif left is not None:
                _label_totals(left["features"], read(row), starts[:-1], totals)
        if left is None:
            return
        sums = [_score_sum(totals[:, a:b], left["labels"][:, i], left["weight"], sizes[a:b]) for i, (a, b) in enumerate(zip(starts, starts[1:]))]
        yield pd.DataFrame({"at": range(len(sums)), "s": sums, "w": left["weight"].sum()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of a partition one after another; rows come sorted, a block's own first."""
        rows = (row for batch in batches for _, row in batch.iterrows())
        for _, block in groupby(rows, key=lambda row: row["l"]):
            yield from scored(block)

    dealt = rows.repartitionById(blocks, "l").sortWithinPartitions("l", "r")
    found = dealt.mapInPandas(run, "at int, s double, w double").groupBy("at").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).collect()
    means = {r["at"]: r["s"] / r["w"] for r in found}
    return [means.get(i) if np.count_nonzero(sizes[a:b]) > 1 else None for i, (a, b) in enumerate(zip(starts, starts[1:]))]


def _score_sum(totals: np.ndarray, label: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> float:
    """Weighted sum of the silhouettes of rows with these distance totals per label."""
    rows, own = np.arange(len(label)), sizes[label]
    a = np.where(own > 1, totals[rows, label] / np.maximum(own - 1, 1), 0.0)
    means = np.where(sizes > 0, totals / np.maximum(sizes, 1), np.inf)
    means[rows, label] = np.inf
    b = means.min(axis=1)
    widest = np.maximum(a, b)
    ok = (own > 1) & (widest > 0) & np.isfinite(b)
    return float((np.where(ok, (b - a) / np.where(ok, widest, 1.0), 0.0) * weight).sum())


def nt_xent(views: DataFrame, temperature: float = 0.07, batch_rows: int = 128) -> DataFrame:
    """Contrastive loss of two views ``(row_id, z1, z2)`` per batch.

    Rows are batched in ``row_id`` order, ``batch_rows`` at a time, and are
    compared inside their batch only, which bounds the group. A ``batch_id``
    column that is already there is used as it is, under the same bound.
    """
    if batch_rows > MAX_BATCH_ROWS:
        raise ValueError(f"a batch may hold at most {MAX_BATCH_ROWS} rows")
    if "batch_id" not in views.columns:
        indexed = with_dense_index(views.select("row_id", "z1", "z2"), ["row_id"], "_position")
        views = indexed.withColumn("batch_id", F.floor(F.col("_position") / batch_rows))

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        views = np.vstack([np.stack(pdf["z1"].to_numpy()), np.stack(pdf["z2"].to_numpy())])
        norms = np.linalg.norm(views, axis=1, keepdims=True)
        views = views / np.where(norms < 1e-12, 1e-12, norms)
        logits = views @ views.T / temperature
        n = len(pdf)
        if n > MAX_BATCH_ROWS:
            raise ValueError(f"batch {pdf['batch_id'].iloc[0]} holds {n} rows, more than {MAX_BATCH_ROWS}")
        positive = logits[np.arange(2 * n), np.r_[n : 2 * n, 0:n]]
        np.fill_diagonal(logits, -np.inf)
        top = logits.max(axis=1)
        spread = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "n_pairs": [n], "loss": [float((spread - positive).mean())]})

    return views.select(F.col("batch_id").cast("long"), "z1", "z2").groupBy("batch_id").applyInPandas(
        loss, "batch_id long, n_pairs long, loss double"
    )


__all__ = [
    "adjusted_rand", "calculate_metrics", "calinski_harabasz", "davies_bouldin", "elbow_scores", "evaluate_model", "label_agreement",
    "label_counts", "normalized_mutual_info", "nt_xent", "silhouette", "silhouette_rows",
]
