"""Divisive clustering: a tree of two-means splits, all leaves of a level split in the same passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.sampling import broadcast_if_small
from starling.operators.prepare import width

MAX_ROUNDS = 50
TOL = 1e-4
FOLD_ROWS = 8192
NODE_SCHEMA = "node int, parent int, depth int, rows long, cost double, center array<double>, cluster int"


@dataclass(frozen=True)
class DivisiveFit:
    """``nodes``: one row per node of the tree, ``cluster`` set on its leaves."""

    labels: DataFrame
    nodes: DataFrame
    n_clusters: int


@dataclass
class _Node:
    parent: int
    depth: int
    count: float
    mean: np.ndarray
    spread: np.ndarray  # squared deviations, by dimension
    children: tuple[int, int] | None = None
    centers: np.ndarray | None = None  # of the two sides
    whole: bool = False  # cannot be split


def _descend(x: np.ndarray, nodes: list[_Node]) -> np.ndarray:
    """The leaf of each row: at every split the side of the nearer centre, ties to the first."""
    at = np.zeros(len(x), dtype=np.int64)
    inner = np.array([n.children is not None for n in nodes])
    low = np.array([n.children[0] if n.children else 0 for n in nodes])
    high = np.array([n.children[1] if n.children else 0 for n in nodes])
    first = np.array([n.centers[0] if n.children else np.zeros(x.shape[1]) for n in nodes])
    second = np.array([n.centers[1] if n.children else np.zeros(x.shape[1]) for n in nodes])
    while True:
        moving = np.flatnonzero(inner[at])
        if not len(moving):
            return at
        node = at[moving]
        nearer = ((x[moving] - second[node]) ** 2).sum(axis=1) < ((x[moving] - first[node]) ** 2).sum(axis=1)
        at[moving] = np.where(nearer, high[node], low[node])


def _fold(rows: DataFrame, nodes: list[_Node], splits: dict[int, np.ndarray], middle: np.ndarray) -> np.ndarray:
    """Counts, sums and squared sums of the rows at each side of each split, about ``middle``."""
    dims = len(middle)
    ids = sorted(splits)
    place = np.full(len(nodes), -1)
    place[ids] = np.arange(len(ids))
    centers = np.stack([splits[i] for i in ids])
    values = 2 * len(ids) * (1 + 2 * dims)

    def fold(batches):
        total = np.zeros((2 * len(ids), 1 + 2 * dims))
        for batch in batches:
            every = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for begin in range(0, len(every), FOLD_ROWS):
                x = every[begin : begin + FOLD_ROWS]
                own = place[_descend(x, nodes)]
                x, own = x[own >= 0], own[own >= 0]
                nearer = ((x - centers[own, 1]) ** 2).sum(axis=1) < ((x - centers[own, 0]) ** 2).sum(axis=1)
                side, y = 2 * own + nearer, x - middle
                total[:, 0] += np.bincount(side, minlength=len(total))
                for j in range(dims):
                    total[:, 1 + j] += np.bincount(side, weights=y[:, j], minlength=len(total))
                    total[:, 1 + dims + j] += np.bincount(side, weights=y[:, j] ** 2, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(values), pa.int32()), pa.array(total.ravel())], ["position", "value"])

    folded = rows.mapInArrow(fold, "position int, value double").groupBy("position").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(values)
    out[folded["position"]] = folded["value"]
    return out.reshape(len(ids), 2, 1 + 2 * dims)


def _start(node: _Node) -> np.ndarray:
    """Two centres a deviation before and behind the mean, along the first of the widest dimensions."""
    # Equal spreads, as of scaled columns, differ by rounding.
    j = int(np.flatnonzero(node.spread >= node.spread.max() * (1 - 1e-9))[0])
    step = np.zeros(len(node.mean))
    step[j] = np.sqrt(node.spread[j] / node.count)
    return np.stack([node.mean - step, node.mean + step])


def divisive(ff: DataFrame, k: int = 3) -> DivisiveFit:
    """k clusters by splitting, numbered by their smallest row id.

    Level by level every leaf is split by two-means, the leaves with most rows
    first where fewer splits are left. All splits of a level share one scan per
    round, and k x d numbers describe the tree. Leaves of equal points stay
    whole, so there are fewer clusters where points run out. This is a method of
    its own, not a form of agglomerative clustering.
    """
    if k < 1:
        raise ValueError("k must be positive")
    data = ff.select("row_id", "features").persist()
    try:
        dims, rows = width(data), data.select("features")
        top = _fold(rows, [_Node(-1, 0, 0, np.zeros(dims), np.zeros(dims))], {0: np.zeros((2, dims))}, np.zeros(dims))[0].sum(axis=0)
        if not top[0]:
            raise ValueError("no rows to cluster")
        middle = top[1 : 1 + dims] / top[0]
        again = _fold(rows, [_Node(-1, 0, 0, middle, middle)], {0: np.stack([middle, middle])}, middle)[0].sum(axis=0)
        nodes = [_made(-1, 0, again, middle)]
        while True:
            leaves = [i for i, n in enumerate(nodes) if n.children is None]
            ready = sorted((i for i in leaves if not nodes[i].whole), key=lambda i: (-nodes[i].count, i))[: k - len(leaves)]
            if not ready:
                break
            _split(rows, nodes, ready, middle)
        labels = _labelled(ff, nodes)
        firsts = {r["leaf"]: c for c, r in enumerate(labels.groupBy("leaf").agg(F.min("row_id").alias("first")).orderBy("first").collect())}
    finally:
        data.unpersist()
    spark = ff.sparkSession
    table = spark.createDataFrame(
        [(i, n.parent if i else None, n.depth, int(n.count), float(n.spread.sum()), n.mean.tolist(), firsts.get(i)) for i, n in enumerate(nodes)], NODE_SCHEMA
    )
    numbers = table.where("cluster IS NOT NULL").select(F.col("node").alias("leaf"), "cluster")
    return DivisiveFit(labels.join(broadcast_if_small(numbers, 2), "leaf").select(*ff.columns, "cluster"), table, len(firsts))


def _made(parent: int, depth: int, folded: np.ndarray, middle: np.ndarray) -> _Node:
    dims, count = len(middle), folded[0]
    mean = folded[1 : 1 + dims] / count
    spread = np.maximum(folded[1 + dims :] - count * mean**2, 0.0)
    # Squares about the middle of all rows: what is left of equal points is rounding.
    spread[spread <= 1e-12 * np.maximum(folded[1 + dims :], 1e-300)] = 0.0
    return _Node(parent, depth, count, mean + middle, spread, whole=count < 2 or not spread.any())


def _split(rows: DataFrame, nodes: list[_Node], ready: list[int], middle: np.ndarray) -> None:
    """Two-means of all leaves in ``ready`` at once; each gets children, or is marked whole."""
    dims = len(middle)
    moving = {i: _start(nodes[i]) for i in ready}
    for turn in range(MAX_ROUNDS):
        if not moving:
            break
        for i, sides in zip(sorted(moving), _fold(rows, nodes, moving, middle)):
            if not sides[:, 0].all():
                nodes[i].whole = True
                del moving[i]
                continue
            means = sides[:, 1 : 1 + dims] / sides[:, :1] + middle
            shift = ((means - moving[i]) ** 2).sum()
            if shift <= TOL * nodes[i].spread.sum() / nodes[i].count or turn == MAX_ROUNDS - 1:
                # The tree keeps the centres that these counts were made with.
                nodes[i].centers, nodes[i].children = moving.pop(i), (len(nodes), len(nodes) + 1)
                nodes.extend(_made(i, nodes[i].depth + 1, side, middle) for side in sides)
            else:
                moving[i] = means


def _labelled(ff: DataFrame, nodes: list[_Node]) -> DataFrame:
    shared = ff.sparkSession.sparkContext.broadcast(nodes)

    @F.pandas_udf("int")
    def leaf(features: pd.Series) -> pd.Series:
        return pd.Series(_descend(np.stack(features.to_numpy()), shared.value)) if len(features) else pd.Series([], dtype="int32")

    return ff.withColumn("leaf", leaf("features"))
