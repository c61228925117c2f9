"""Spectral clustering with an RBF affinity: exact for any number of rows, or through landmark rows.

The affinity of many points is never held: products with it come from pairs of
bounded blocks on the executors, or in one or two columns from boxes that stand
for their points to rounding error, and a block Davidson iteration (residuals of
the leading Ritz vectors widen a basis that is a column of the point table)
needs only inner products of the basis in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.blocks import Block, block_pairs, distances
from starling.functions.sampling import hash_sample
from starling.functions.vectors import hash_uniform
from starling.operators.kmeans import kmeans
from starling.session import cut_lineage

# Up to this many points the eigenproblem is solved in one place.
MAX_LANDMARKS = 2000
# Vectors sought besides the wanted ones, blocks of vectors in the widest basis, and products with the affinity at most.
EXTRA, BASIS_BLOCKS, MAX_PRODUCTS = 4, 8, 300
# Points of at most two columns meet through boxes of side 1 / sqrt(gamma), if so few hold them all: in such a box 16
# Chebyshev nodes a column carry the Gaussian with an error below 1e-12 of its largest value.
MAX_BOXES, NODES, BOXED_DIMS, BOXED_ROWS = 400, 16, 2, 4096
# Up to this many points all pairs meet, which is as fast.
BOXED_FROM = 50_000
# Largest norm of S v - value v for a unit vector v; the largest eigenvalue is 1.
RESIDUAL = 1e-6


@dataclass(frozen=True)
class SpectralFit:
    labels: DataFrame
    n_clusters: int
    landmarks: int
    exact: bool


def spectral(ff: DataFrame, k: int = 8, gamma: float = 1.0, landmarks: int | None = None, n_init: int = 10, seed: int = 42) -> SpectralFit:
    """k-means on the leading eigenvectors of the normalised affinity.

    The eigenvectors are those of all distinct points; above ``MAX_LANDMARKS``
    of them each product with the affinity takes one quadratic, block-wise pass, or
    a linear one where few boxes hold all points (see ``_occupied``).
    With ``landmarks`` they are taken on a hash sample of so many distinct
    points and carried over to all rows (Nystroem extension): one m x m
    eigenproblem of bounded size and one pass over the rows.
    """
    asked, landmarks = landmarks, MAX_LANDMARKS if landmarks is None else landmarks
    if landmarks > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    points = cut_lineage(ff.groupBy("features").agg(F.min("row_id").alias("id"), F.count("*").alias("n")))
    total = points.count()
    exact = total <= landmarks or asked is None
    if total > landmarks and asked is None:
        embedded = ff.select("row_id", F.col("features").alias("point")).join(
            _exact_coordinates(points, k, gamma, seed).withColumnRenamed("features", "point"), "point"
        ).select("row_id", F.col("coordinates").alias("features"))
        used = total
    else:
        picked = hash_sample(points, landmarks, "id", seed)
        picked = sorted(picked, key=lambda r: r["id"])
        embedding = _extension(
            np.array([list(r["features"]) for r in picked], dtype=float), np.array([r["n"] for r in picked], dtype=float), k, gamma
        )
        embedded, used = ff.select("row_id", embedding("features").alias("features")), len(picked)
    fit = kmeans(embedded, k, n_init=n_init, seed=seed)
    labels = ff.join(fit.labels.select("row_id", "cluster"), "row_id").select(*ff.columns, "cluster")
    return SpectralFit(labels, fit.n_clusters, used, exact)


def _affinity_times(points: DataFrame, columns: str, width: int, gamma: float, boxes: np.ndarray | None = None) -> DataFrame:
    """``(row_id, product)``: the affinity of all pairs times the array column ``columns`` of ``width`` numbers."""
    if boxes is not None:
        return _boxed_times(points, columns, width, gamma, boxes)

    def product(left: Block, right: Block) -> pd.DataFrame:
        x, y = right["features"][:, :-width], right["features"][:, -width:]
        sums = np.exp(-gamma * distances(left["features"], x, squared=True)) @ y
        return pd.DataFrame({"row_id": left["row_id"]} | {f"y{j}": sums[:, j] for j in range(width)})

    id_type = points.schema["row_id"].dataType.simpleString()
    right = points.select("row_id", F.concat("features", columns).alias("features"))
    parts = block_pairs(points.select("row_id", "features"), right, product, ", ".join([f"row_id {id_type}", *(f"y{j} double" for j in range(width))]))
    return parts.groupBy("row_id").agg(F.array(*[F.sum(f"y{j}") for j in range(width)]).alias("product"))


def _occupied(points: DataFrame, gamma: float) -> np.ndarray | None:
    """The boxes that hold points, or None where pairs of points have to be met."""
    odd = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * float(np.sqrt(gamma)) > 1e9))
    odd = F.coalesce((F.size("features") > BOXED_DIMS) | (F.size("features") < 1) | odd, F.lit(True))
    if gamma <= 0 or points.where(odd).limit(1).count():
        return None
    corner = F.transform("features", lambda x: F.floor(x * F.lit(float(np.sqrt(gamma)))))
    rows = points.select(corner.alias("box")).distinct().limit(MAX_BOXES + 1).collect()
    return np.array(sorted(r["box"] for r in rows), dtype=float) if 0 < len(rows) <= MAX_BOXES else None


def _carried(x: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Values of the nodes' interpolation polynomials at the rows ``x`` of a box, all in units of its side."""
    degrees = np.arange(NODES)
    at = np.cos((degrees + 0.5) * np.pi / NODES)
    spread = np.cos(np.arccos(at)[None, :] * degrees[:, None]) * np.where(degrees == 0, 1.0, 2.0)[:, None] / NODES
    carried = np.ones((len(x), 1))
    for j in range(x.shape[1]):
        inside = np.clip(2.0 * (x[:, j] - box[j]) - 1.0, -1.0, 1.0)
        values = np.cos(np.arccos(inside)[:, None] * degrees[None, :]) @ spread
        carried = (carried[:, :, None] * values[:, None, :]).reshape(len(x), -1)
    return carried


def _meet_boxes(moments: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The affinity of all boxes' nodes times ``moments`` (boxes, nodes, columns): every pair of boxes counts."""
    dims, out = boxes.shape[1], np.zeros_like(moments)
    nodes = (np.cos((np.arange(NODES) + 0.5) * np.pi / NODES) + 1.0) / 2.0
    kernel = lambda shift: np.exp(-((nodes[:, None] - nodes[None, :] - shift) ** 2))
    known = {shift: kernel(shift) for shift in {float(s) for column in boxes.T for s in np.unique(column[:, None] - column[None, :])}}
    shaped = moments.reshape(len(boxes), *[NODES] * dims, -1)
    for i, box in enumerate(boxes):
        for other, there in enumerate(boxes):
            value = shaped[other]
            for j in range(dims):
                value = np.moveaxis(np.tensordot(known[float(there[j] - box[j])], value, axes=(1, j)), 0, j)
            out[i] += value.reshape(out[i].shape)
    return out


def _boxed_times(points: DataFrame, columns: str, width: int, gamma: float, boxes: np.ndarray) -> DataFrame:
    """As ``_affinity_times``, linear in the points: boxes gather weights at their nodes, meet, and hand them back (fast Gauss transform)."""
    unit, size = float(np.sqrt(gamma)), NODES ** boxes.shape[1]
    place = {tuple(box): i for i, box in enumerate(boxes.tolist())}

    def by_box(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = np.stack(batch["features"].to_numpy()) * unit
        own = np.array([place[tuple(corner)] for corner in np.floor(x).tolist()])
        order = np.argsort(own, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            for at in range(0, len(rows), BOXED_ROWS):
                some = rows[at : at + BOXED_ROWS]
                yield own[some[0]], some, _carried(x[some], boxes[own[some[0]]])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments = np.zeros((len(boxes), size, width))
        for batch in batches:
            if len(batch):
                y = np.stack(batch[columns].to_numpy())
                for i, rows, carried in by_box(batch):
                    moments[i] += carried.T @ y[rows]
        used = np.flatnonzero(moments.any(axis=(1, 2)))
        if len(used):
            yield pd.DataFrame({"box": np.repeat(used, size), "node": np.tile(np.arange(size), len(used)), "y": list(moments[used].reshape(-1, width))})

    parts = points.select("features", columns).mapInPandas(gather, "box int, node int, y array<double>")
    summed = parts.groupBy("box", "node").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(width)]).toPandas()
    moments = np.zeros((len(boxes), size, width))
    moments[summed["box"], summed["node"]] = summed[[f"y{j}" for j in range(width)]].to_numpy()
    met = _meet_boxes(moments, boxes)

    def hand_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                product = np.zeros((len(batch), width))
                for i, rows, carried in by_box(batch):
                    product[rows] = carried @ met[i]
                yield pd.DataFrame({"row_id": batch["row_id"], "product": list(product)})

    id_type = points.schema["row_id"].dataType.simpleString()
    return points.select("row_id", "features").mapInPandas(hand_back, f"row_id {id_type}, product array<double>")


def _inner_products(frame: DataFrame) -> np.ndarray:
    """Inner products of all columns of basis and image, folded in the tasks."""

    def fold(batches):
        total = None
        for batch in batches:
            if len(batch):
                z = np.hstack([np.stack(batch[c].to_numpy()) for c in ("basis", "image")])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    parts = [np.array(r["g"]) for r in frame.select("basis", "image").mapInPandas(fold, "g array<double>").collect()]
    total = np.sum(parts, axis=0)
    return total.reshape(int(np.sqrt(len(total))), -1)


def _exact_coordinates(points: DataFrame, k: int, gamma: float, seed: int) -> DataFrame:
    """``(features, coordinates)``: the k leading eigenvectors of the normalised affinity of all points."""
    points = points.withColumnRenamed("id", "row_id")
    boxes = _occupied(points, gamma) if points.count() > BOXED_FROM else None
    degree = _affinity_times(points.withColumn("w", F.array(F.col("n").cast("double"))), "w", 1, gamma, boxes)
    points = points.join(degree, "row_id").withColumn("degree", F.col("product")[0]).drop("product")
    width = k + EXTRA
    # The square root of the weighted degrees is an eigenvector of the value 1.
    start = [F.sqrt(F.col("n") * F.col("degree"))] + [hash_uniform(seed, F.col("row_id"), F.lit("start"), F.lit(j)) - 0.5 for j in range(1, width)]
    points = cut_lineage(points.select("row_id", "features", "n", F.sqrt(F.col("n") / F.col("degree")).alias("scale"), F.array(*start).alias("fresh")))
    none = F.array().cast("array<double>")
    state = points.select("row_id", "fresh", none.alias("basis"), none.alias("image"))
    fixed = points.select("row_id", "features", "n", "scale")
    for _ in range(MAX_PRODUCTS):
        scaled = fixed.join(state.select("row_id", "fresh"), "row_id").withColumn("fresh", F.transform("fresh", lambda v: v * F.col("scale")))
        product = _affinity_times(scaled.select("row_id", "features", "fresh"), "fresh", width, gamma, boxes)
        state = cut_lineage(
            state.join(product, "row_id").join(fixed.select("row_id", "scale"), "row_id").select(
                "row_id", F.concat("basis", "fresh").alias("basis"),
                F.concat("image", F.transform("product", lambda v: v * F.col("scale"))).alias("image"),
            )
        )
        products = _inner_products(state)
        size = len(products) // 2
        lengths, turn = np.linalg.eigh(products[:size, :size])
        white = turn[:, lengths > 1e-12 * lengths[-1]] / np.sqrt(lengths[lengths > 1e-12 * lengths[-1]])
        across = white.T @ (products[:size, size:] + products[size:, :size]) @ white / 2
        values, vectors = np.linalg.eigh(across)
        values, vectors = values[::-1], white @ vectors[:, ::-1]
        wanted = vectors[:, :k]
        residuals = np.vstack([-vectors[:, : k + EXTRA] * values[: k + EXTRA], vectors[:, : k + EXTRA]])
        left_over = residuals.T @ products @ residuals
        if np.sqrt(np.maximum(np.diag(left_over)[:k], 0.0)).max() <= RESIDUAL:
            done = _transformed(state, "coordinates", lambda z: z[:, :size] @ wanted)
            return fixed.join(done, "row_id").select("features", F.transform("coordinates", lambda v: v * F.col("scale") / F.col("n")).alias("coordinates"))
        norms, turn = np.linalg.eigh(left_over)
        good = norms > max(1e-14 * norms[-1], 1e-18)
        fresh = residuals @ (turn[:, good] / np.sqrt(norms[good]))
        width = fresh.shape[1]
        # A full basis shrinks to its best vectors.
        keep = vectors[:, : 2 * (k + EXTRA)] if size + width > BASIS_BLOCKS * (k + EXTRA) else np.eye(size)
        state = cut_lineage(_transformed(
            state, None, lambda z, keep=keep, fresh=fresh, size=size: (z @ fresh, z[:, :size] @ keep, z[:, size:] @ keep)
        ))
    raise RuntimeError(f"the eigenvectors did not settle within {MAX_PRODUCTS} products with the affinity")


def _transformed(state: DataFrame, name: str | None, change) -> DataFrame:
    """``row_id`` with linear combinations of basis and image: one column, or fresh, basis and image anew."""
    names = [name] if name else ["fresh", "basis", "image"]

    def run(batches):
        for batch in batches:
            if len(batch):
                out = change(np.hstack([np.stack(batch[c].to_numpy()) for c in ("basis", "image")]))
                yield pd.DataFrame({"row_id": batch["row_id"]} | {c: list(v) for c, v in zip(names, (out,) if name else out)})

    id_type = state.schema["row_id"].dataType.simpleString()
    return state.select("row_id", "basis", "image").mapInPandas(run, ", ".join([f"row_id {id_type}", *(f"{c} array<double>" for c in names)]))


def _extension(marks: np.ndarray, weights: np.ndarray, k: int, gamma: float):
    """Function from features to the k spectral coordinates."""
    kernel = np.exp(-gamma * distances(marks, marks, squared=True))
    degree = kernel @ weights
    scale = np.sqrt(weights / degree)
    values, vectors = np.linalg.eigh(kernel * scale[:, None] * scale[None, :])
    top = np.argsort(values)[::-1][: min(k, len(values))]
    values, vectors = np.maximum(values[top], 1e-12), vectors[:, top]
    biggest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[biggest, np.arange(len(top))])
    # A row's coordinate is the kernel-weighted mean of the landmarks' ones.
    carry = vectors * np.sqrt(weights / degree)[:, None] / values

    @F.pandas_udf("array<double>")
    def embed(features: pd.Series) -> pd.Series:
        near = np.exp(-gamma * distances(np.stack(features.to_numpy()), marks, squared=True))
        mass = np.maximum(near @ weights, 1e-300)
        return pd.Series(list((near @ carry) / mass[:, None]))

    return embed
