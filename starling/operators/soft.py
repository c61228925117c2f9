"""Soft assignment and self-training refinement of cluster centres."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.functions.blocks import distances
from starling.functions.vectors import array_sum, squared_distance_dims
from starling.operators.kmeans import SHIPPED_VALUES, UNROLL_TERMS, centers_frame, kmeans, small_centers
from starling.operators.prepare import width
from starling.operators.reduce import fit_pca


def _point(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _kernel(points: list[list[float]], alpha: float) -> Column:
    """Unnormalised Student-t similarity to each centre."""
    dims = len(points[0])
    power = (alpha + 1.0) / 2.0
    terms = []
    for p in points:
        base = 1.0 / (1.0 + squared_distance_dims(F.col("features"), _point(p), dims) / alpha)
        terms.append(base if power == 1.0 else F.pow(base, F.lit(power)))
    return F.array(*terms)


def _soft(frame: DataFrame, points: list[list[float]], alpha: float) -> DataFrame:
    """Add ``q``: a compiled expression for few centre values, Arrow batches for many."""
    if len(points) * len(points[0]) > UNROLL_TERMS:
        matrix = np.asarray(points, dtype=float)

        @F.pandas_udf("array<double>")
        def memberships(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy())
            return pd.Series([q for part in _chunks(x, matrix) for q in _memberships(part, matrix, alpha)[0]])

        return frame.withColumn("q", memberships("features"))
    return (
        frame.withColumn("_kernel", _kernel(points, alpha))
        .withColumn("_sum", array_sum(F.col("_kernel")))
        .withColumn("q", F.transform("_kernel", lambda x: x / F.col("_sum")))
        .drop("_kernel", "_sum")
    )


def _chunks(x: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """Rows a few at a time, so that a table of rows by centres stays small."""
    step = max(1, 1_000_000 // len(points))
    return [x[at : at + step] for at in range(0, len(x), step)]


def _memberships(x: np.ndarray, points: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """q, and 1 / (1 + squared distance / alpha), of every row and centre."""
    near = 1.0 / (1.0 + distances(x, points, squared=True) / alpha)
    kernel = near ** ((alpha + 1.0) / 2.0)
    return kernel / kernel.sum(axis=1, keepdims=True), near


def _folded(z: DataFrame, points: np.ndarray, size: int, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``fold``'s ``size`` numbers per batch; a task sends its own sum once."""
    dims = points.shape[1]

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for part in _chunks(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), points):
                total += fold(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["position", "value"])

    parts = z.select("features").mapInArrow(run, "position int, value double")
    cells = parts.groupBy("position").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[cells["position"].to_numpy()] = cells["value"].to_numpy()
    return out


def _local(centers: DataFrame) -> list[list[float]]:
    local = small_centers(centers)
    if local is None:
        raise ValueError(f"soft assignment keeps all centres in every row; more than {SHIPPED_VALUES} values")
    return local[1]


def soft_assign(ff: DataFrame, centers: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Add ``q``: membership in each centre (by label order), rows sum to 1."""
    return _soft(ff, _local(centers), alpha)


def cluster_masses(soft: DataFrame) -> list[float]:
    """f_j = sum over rows of q_j."""
    rows = soft.select(F.posexplode("q")).groupBy("pos").agg(F.sum("col").alias("mass")).collect()
    return [r["mass"] for r in sorted(rows, key=lambda r: r["pos"])]


def target_distribution(soft: DataFrame) -> DataFrame:
    """Add ``p``: q squared over the cluster mass, renormalised per row.

    The masses are sums over the whole table, not over a batch.
    """
    return _target(soft, cluster_masses(soft))


def _target(soft: DataFrame, masses: list[float]) -> DataFrame:
    weights = F.array(*[F.lit(1.0 / f) for f in masses])
    return (
        soft.withColumn("_w", F.zip_with("q", weights, lambda q, w: q * q * w))
        .withColumn("_sum", array_sum(F.col("_w")))
        .withColumn("p", F.transform("_w", lambda x: x / F.col("_sum")))
        .drop("_w", "_sum")
    )


def kl_divergence(targeted: DataFrame) -> DataFrame:
    """One row ``kl``: sum of p log(p / q) per row, averaged over the rows."""
    term = F.zip_with("p", "q", lambda p, q: F.when(p > 0.0, p * F.ln(p / q)).otherwise(0.0))
    return targeted.agg(F.avg(array_sum(term)).alias("kl"))


@dataclass(frozen=True)
class DecFit:
    labels: DataFrame
    centers: DataFrame
    losses: list[float]


def dec_refine(z: DataFrame, centers: DataFrame, rounds: int = 10, lr: float = 0.1, alpha: float = 1.0) -> DecFit:
    """Move the centres down the gradient of KL(p || q), p frozen per round.

    ``z`` is a feature frame of latent rows. A round costs two passes, one for
    the cluster masses and one for the gradient; both are k x d sums.
    """
    points = _local(centers)
    losses = []
    cached = z.persist()
    try:
        for _ in range(rounds):
            loss, gradient = _gradient(cached, np.asarray(points, dtype=float), alpha)
            losses.append(loss)
            points = (np.asarray(points, dtype=float) - lr * gradient).tolist()
    finally:
        cached.unpersist()
    soft = _soft(z, points, alpha)
    hard = F.array_position("q", F.array_max("q")).cast("int") - 1
    return DecFit(soft.withColumn("cluster", hard), centers_frame(z.sparkSession, points), losses)


def _gradient(z: DataFrame, points: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Mean KL(p || q), and the mean over the rows of (alpha+1)/alpha * (1+d2/alpha)^-1 (q-p) (z-centre)."""
    k, dims = points.shape
    masses = _folded(z, points, k, lambda x: _memberships(x, points, alpha)[0].sum(axis=0))

    def fold(x: np.ndarray) -> np.ndarray:
        q, near = _memberships(x, points, alpha)
        p = q**2 / masses
        p /= p.sum(axis=1, keepdims=True)
        loss = np.where(p > 0.0, p * np.log(np.where(p > 0.0, p, 1.0) / np.where(q > 0.0, q, 1.0)), 0.0).sum()
        force = (q - p) * ((alpha + 1.0) / alpha) * near
        pull = force.T @ x - force.sum(axis=0)[:, None] * points
        return np.concatenate([[len(x), loss], pull.ravel()])

    sums = _folded(z, points, 2 + k * dims, fold)
    n = max(sums[0], 1.0)
    return float(sums[1] / n), sums[2:].reshape(k, dims) / n


def deep_embedding(
    ff: DataFrame, k: int, latent_dim: int = 10, alpha: float = 1.0, rounds: int = 10, lr: float = 0.1,
    n_init: int = 10, seed: int = 42,
) -> DecFit:
    """Linear encoder (PCA), k-means start, self-training refinement."""
    dims = width(ff)
    z = fit_pca(ff, min(latent_dim, dims)).project(ff).persist()
    try:
        start = kmeans(z, k, n_init=n_init, seed=seed)
        return dec_refine(z, start.centers, rounds, lr, alpha)
    finally:
        z.unpersist()


__all__ = [
    "DecFit", "cluster_masses", "dec_refine", "deep_embedding", "kl_divergence", "soft_assign", "target_distribution",
]
