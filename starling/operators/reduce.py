"""Principal components: fit, project, reconstruct."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.vectors import squared_distance_dims
from starling.operators.moments import UNROLL, group_moments
from starling.operators.prepare import width, with_width

# Up to this many features the covariance is one matrix on the driver (2 GB).
DENSE_COLUMNS = 16384
# Rows of the covariance's product that are summed as one value.
STRIP = 1024
_PIECE = 256


@dataclass(frozen=True)
class PcaModel:
    """Mean, components (one row per component) and explained variance ratios."""

    mean: np.ndarray
    components: np.ndarray
    explained_variance_ratio: np.ndarray

    def project(self, ff: DataFrame) -> DataFrame:
        """Centred rows times the components."""
        project = self._linear(self.components.T, -self.mean @ self.components.T)
        return ff.withColumns({"features": with_width(project(F.col("features")), len(self.components))})

    def back_project(self, projected: DataFrame) -> DataFrame:
        restore = self._linear(self.components, self.mean)
        return projected.withColumns({"features": with_width(restore(F.col("features")), len(self.mean))})

    def reconstruction_error(self, ff: DataFrame) -> DataFrame:
        """``(row_id, error)``: mean squared error of projecting there and back."""
        smooth = self.components.T @ self.components
        restored = self._linear(smooth, self.mean - self.mean @ smooth)(F.col("features"))
        return ff.withColumn("_restored", restored).select(
            "row_id",
            (squared_distance_dims(F.col("features"), F.col("_restored"), len(self.mean)) / len(self.mean)).alias("error"),
        )

    @staticmethod
    def _linear(matrix: np.ndarray, shift: np.ndarray):
        # d x k numbers, fixed by the model and not by the number of rows.
        matrix, shift = np.ascontiguousarray(matrix), np.asarray(shift)

        @F.pandas_udf("array<double>")
        def apply(features: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(features.to_numpy()) @ matrix + shift))

        return apply


def column_means(ff: DataFrame) -> np.ndarray:
    row = group_moments(ff.withColumn("_all", F.lit(0)), by="_all").first()
    return np.array(row["center"])


def fit_pca(ff: DataFrame, n_components: int) -> PcaModel:
    """Components of the centred rows; the largest loading of each is positive.

    The d x d covariance is summed up on the executors; only it and the
    components meet on the driver.
    """
    dims = width(ff)
    k = min(n_components, dims)
    mean = column_means(ff)
    # The covariance sums centre the rows themselves; PCA.transform would not,
    # which is why the projection above is done with the mean taken off.
    model = PCA(k=k, inputCol="v", outputCol="o").fit(ff.select(array_to_vector("features").alias("v")))
    components = model.pc.toArray().T
    biggest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(k), biggest])
    return PcaModel(mean, components * np.where(signs == 0, 1, signs)[:, None], model.explainedVariance.toArray())


def fit_pca_range(
    ff: DataFrame, n_components: int, oversample: int = 10, tol: float = 1e-10, max_rounds: int = 100, seed: int = 42,
) -> PcaModel:
    """The same components without a d x d matrix, for tens of thousands of columns.

    A random range of ``n_components + oversample`` directions is refined: each
    round is one scan that applies the covariance to the current directions,
    their residuals and the last steps, and keeps the best combinations. Rounds
    end once the residuals of all components are within ``tol`` of the largest
    variance; ``max_rounds`` without that is an error, never a rougher answer.
    Three d x (n_components + oversample) blocks are all that is in one place.
    Where these span all d columns, the first scan already holds everything.
    """
    dims = width(ff)
    k = min(n_components, dims)
    moments = group_moments(ff.withColumn("_all", F.lit(0)), by="_all").first()
    if moments is None:
        raise ValueError("the feature frame is empty")
    n, mean = moments["n"], np.array(moments["center"])
    if n < 2:
        raise ValueError("principal components need two rows at least")
    scatter = float(np.square(moments["std"]).sum()) * n / (n - 1)
    size = min(dims, k + oversample)
    found, steps, residual = np.random.default_rng(seed).standard_normal((dims, size)), None, None
    for _ in range(max_rounds):
        basis = _orthonormal([b for b in (found, residual, steps) if b is not None], whole=3 * size >= dims)
        image = _apply_covariance(ff, mean, n, basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:size], mix[:, ::-1][:, :size]
        before, found = found, basis @ mix
        residual = image @ mix - found * values
        if np.sqrt(np.square(residual[:, :k]).sum(axis=0)).max() <= tol * max(values[0], 0.0):
            break
        # What of the new directions lies outside the old ones: the way of the last step.
        old = np.linalg.qr(before)[0]
        steps = found - old @ (old.T @ found)
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds; take more oversampling")
    components = found[:, :k].T
    biggest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(k), biggest])
    ratios = np.maximum(values[:k], 0.0) / scatter if scatter > 0 else np.zeros(k)
    return PcaModel(mean, components * np.where(signs == 0, 1, signs)[:, None], ratios)


def _orthonormal(blocks: list[np.ndarray], whole: bool) -> np.ndarray:
    """An orthonormal basis of the blocks' columns; of all columns if ``whole``."""
    dims = len(blocks[0])
    if whole:
        return np.eye(dims)
    basis = np.linalg.qr(blocks[0])[0]
    for block in blocks[1:]:
        # Twice: what is left after the first time may be small, and its errors large beside it.
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            norms = np.linalg.norm(block, axis=0)
            block = block[:, norms > 1e-300] / norms[norms > 1e-300]
        left, weights, _ = np.linalg.svd(block, full_matrices=False)
        basis = np.hstack([basis, left[:, weights > 1e-8]])
    return np.linalg.qr(basis)[0]


def _apply_covariance(ff: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sample covariance times ``basis`` in one scan.

    A task adds up its rows and sends strips of ``STRIP`` columns, which Spark
    sums by strip: no reducer holds more than its strips.
    """
    dims, size = basis.shape
    shared = ff.sparkSession.sparkContext.broadcast((mean, np.ascontiguousarray(basis)))

    def fold(batches):
        center, directions = shared.value
        total = np.zeros((dims, size))
        for batch in batches:
            rows = batch.column(0)
            flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)
            for start in range(0, len(flat), _PIECE):
                x = flat[start : start + _PIECE] - center
                total += x.T @ (x @ directions)
        strips = range(0, dims, STRIP)
        sums = pa.array([total[s : s + STRIP].ravel() for s in strips], type=pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(strips), type=pa.int32()), sums], names=["strip", "sums"])

    parts = ff.select("features").mapInArrow(fold, "strip int, sums array<double>")
    added = parts.groupBy("strip").agg(Summarizer.metrics("sum").summary(array_to_vector("sums")).alias("s"))
    result = np.zeros((dims, size))
    for row in added.select("strip", vector_to_array("s.sum").alias("sums")).toLocalIterator():
        result[row["strip"] : row["strip"] + STRIP] = np.reshape(row["sums"], (-1, size))
    shared.unpersist()
    return result / (n - 1)


def reduce_if_wide(ff: DataFrame, n_components: int = 50) -> tuple[DataFrame, PcaModel | None]:
    """PCA only when there are more features than ``n_components``.

    Beyond ``DENSE_COLUMNS`` features the components come from
    :func:`fit_pca_range`, which finds the same ones.
    """
    if width(ff) <= n_components:
        return ff, None
    model = (fit_pca if width(ff) <= DENSE_COLUMNS else fit_pca_range)(ff, n_components)
    return model.project(ff), model


def plot_coordinates(ff: DataFrame, dims: int = 2) -> tuple[DataFrame, list[float]]:
    """2-D or 3-D coordinates and the explained variance ratio of each axis."""
    model = fit_pca(ff, min(dims, width(ff)))
    return model.project(ff), list(model.explained_variance_ratio)


def covariance(ff: DataFrame) -> DataFrame:
    """Sample covariance ``(i, j, value)`` for i <= j, one aggregate pass."""
    dims = width(ff)
    x = F.col("features")
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    if dims > UNROLL:
        raise ValueError(f"the covariance table is for up to {UNROLL} features; fit_pca takes any width")
    row = ff.agg(*[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for i, j in pairs
    ])
    return row.select(F.explode(cells).alias("c")).select("c.i", "c.j", "c.value")
