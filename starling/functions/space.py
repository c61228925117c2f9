"""Rows in the leaves of a k-d tree, and the nearest rows of each row found through them.

The tree's planes come from a bounded sample; they only steer which rows are
compared. A leaf's box is that of the rows that lie in it, so what a box rules
out is ruled out exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.blocks import Block, block_pairs, distances, large_blocks
from starling.functions.sampling import hash_sample
from starling.session import cut_lineage

LEAF_ROWS = 1024
# Leaves of more rows than this, which are equal rows for the most part, are dealt over several with one box.
LEAF_MOST = 8 * LEAF_ROWS
# Sampled rows per leaf, and numbers in the sample at most.
SAMPLE_PER_LEAF, SAMPLE_VALUES = 32, 2_000_000
# Rows that ask at a leaf in one go, and questions per row beyond which boxes do not separate the rows.
ASKING, QUESTIONS = 4096, 16
TILE_VALUES = 500_000
# Boxes are taken this much nearer than computed, which is more than rounding can take them away.
HAIR = 1e-9


@dataclass(frozen=True)
class Planes:
    """A complete binary tree of planes, by level."""

    axis: np.ndarray
    value: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.axis[at]] > self.value[at])
        return at - (2**self.depth - 1)


def planes(sample: np.ndarray, depth: int, middle: float = 0.5, levels: int | None = None) -> Planes:
    """Planes across the longest side, at the widest gap near the middle row (or another share of the rows).

    Another share holds for the first ``levels`` only, if given: through all levels it makes leaves of very unlike size.
    """
    axis, value = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    parts, asked = {0: sample[np.isfinite(sample).all(axis=1)]}, middle
    for at in range(2**depth - 1):
        x = parts.pop(at)
        middle = asked if levels is None or at < 2**levels - 1 else 0.5
        if len(x) > 1:
            axis[at] = (x.max(axis=0) - x.min(axis=0)).argmax()
            column = np.sort(x[:, axis[at]])
            low, high = int((middle - 0.05) * (len(x) - 1)), max(int((middle + 0.05) * (len(x) - 1)), int((middle - 0.05) * (len(x) - 1)) + 1)
            value[at] = column[low + np.diff(column[low : high + 1]).argmax()]
        right = x[:, axis[at]] > value[at]
        parts[2 * at + 1], parts[2 * at + 2] = x[~right], x[right]
    return Planes(axis, value, depth)


def leaves(points: DataFrame, rows: int | None = None, middle: float = 0.5, levels: int | None = None) -> DataFrame:
    """One row per leaf of some ``rows``: ``leaf``, ``rows``, ``lo`` and ``hi``, and an array per column of ``points``."""
    count = points.count()
    depth = max(0, math.ceil(math.log2(count / (rows or LEAF_ROWS)))) if count else 0
    dims = (points.select(F.size("features").alias("d")).first() or {"d": 1})["d"]
    wanted = min(SAMPLE_PER_LEAF * 2**depth, SAMPLE_VALUES // max(dims, 1))
    sample = np.array([r["features"] for r in hash_sample(points.select("row_id", "features"), wanted)], dtype=float) if depth else np.zeros((0, dims))
    tree = planes(sample, depth, middle, levels)

    @F.pandas_udf("long")
    def leaf(features: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(np.array(features.to_list(), dtype=float).reshape(len(features), -1)))

    placed = cut_lineage(points.withColumn("leaf", leaf("features")))
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("_rows")).where(F.col("_rows") > LEAF_MOST)
    parts = {r["leaf"]: math.ceil(r["_rows"] / LEAF_ROWS) for r in sizes.collect()}
    if parts:
        named = points.sparkSession.createDataFrame(list(parts.items()), "leaf long, _parts int")
        dealt = F.pmod(F.xxhash64("row_id"), F.coalesce("_parts", F.lit(1)))
        placed = placed.join(F.broadcast(named), "leaf", "left").withColumn("leaf", F.col("leaf") + 2**depth * dealt).drop("_parts")
    names = points.columns
    packed = placed.repartition(min(2**depth, 2000), "leaf").groupBy("leaf").agg(F.collect_list(F.struct(*names)).alias("_r"))
    fields = [(F.flatten("_r.features") if c == "features" else F.col(f"_r.{c}")).alias(c) for c in names]
    side = lambda j: F.transform("_r.features", lambda x: x[j])
    sides = [F.array(*[f(side(j)) for j in range(dims)]).alias(name) for name, f in (("lo", F.array_min), ("hi", F.array_max))]
    return cut_lineage(packed.select("leaf", F.size("_r").alias("rows"), *sides, *fields))


def unpacked(row: pd.Series, names: list[str]) -> Block:
    block = {c: np.asarray(row[c], dtype=float if c == "features" else None) for c in names}
    block["features"] = block["features"].reshape(len(block["row_id"]), -1)
    return block


def smallest(x: np.ndarray, y: np.ndarray, n: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` smallest distances of each row of ``x`` to rows of ``y``, ascending, and the weights ``n`` of those."""
    wide = max(1, min(len(y), TILE_VALUES // 64))
    tall = max(1, TILE_VALUES // wide)
    found = []
    for at in range(0, len(x), tall):
        gaps = weights = None
        for beside in range(0, len(y), wide):
            new = distances(x[at : at + tall], y[beside : beside + wide])
            own = np.broadcast_to(n[beside : beside + wide], new.shape)
            if gaps is not None:
                new, own = np.hstack([gaps, new]), np.hstack([weights, own])
            if new.shape[1] > count:
                near = np.argpartition(new, count - 1, axis=1)[:, :count]
                new, own = np.take_along_axis(new, near, axis=1), np.take_along_axis(own, near, axis=1)
            gaps, weights = new, own
        order = np.argsort(gaps, axis=1, kind="stable")
        found.append((np.take_along_axis(gaps, order, axis=1), np.take_along_axis(weights, order, axis=1)))
    return np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])


def box_gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Smallest distances between boxes; rows of ``lo`` and ``hi`` against all of ``los`` and ``his``."""
    out = np.zeros((len(lo), len(los)))
    for j in range(lo.shape[1]):
        gap = np.maximum(np.maximum(los[None, :, j] - hi[:, j, None], lo[:, j, None] - his[None, :, j]), 0.0)
        out += gap * gap
    return np.sqrt(out)


def nearest_rows(points: DataFrame, wanted: float) -> DataFrame:
    """``(row_id, gaps, counts)``: lists that together hold each row's nearest rows, up to ``wanted`` by their weights ``n``.

    A row's own leaf bounds how far the rest can lie; it asks only at leaves whose box is nearer.
    """
    count, names = math.ceil(wanted), ["row_id", "features", "n"]
    id_type = points.schema["row_id"].dataType.simpleString()
    schema = f"row_id {id_type}, gaps array<double>, counts array<double>"
    packed = leaves(points.select(*names))
    boxes = packed.select("leaf", "lo", "hi").orderBy("leaf").toPandas()
    if not len(boxes):
        return points.sparkSession.createDataFrame([], schema)
    keys = boxes["leaf"].to_numpy()
    los, his = (np.array(boxes[c].to_list(), dtype=float).reshape(len(keys), -1) for c in ("lo", "hi"))

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                own = unpacked(row, names)
                x = own["features"]
                gaps, counts = smallest(x, x, own["n"], count)
                enough = np.cumsum(counts, axis=1) >= wanted
                bound = np.where(enough.any(axis=1), gaps[np.arange(len(x)), enough.argmax(axis=1)], np.inf)
                lo, hi = (np.asarray(row[c], dtype=float)[None, :] for c in ("lo", "hi"))
                # Not "nearer" but "not farther": missing values rule nothing out.
                close = np.flatnonzero(~(box_gaps(lo, hi, los, his)[0] * (1 - HAIR) > bound.max(initial=0.0)) & (keys != row["leaf"]))
                others = [[]] * len(x)
                if len(close):
                    asked = ~(box_gaps(x, x, los[close], his[close]) * (1 - HAIR) > bound[:, None])
                    others = [keys[close[a]].tolist() for a in asked]
                yield pd.DataFrame({"row_id": own["row_id"], "features": list(x), "gaps": list(gaps), "counts": list(counts), "others": others})

    homes = cut_lineage(packed.repartition(max(1, min(len(keys), 2000)), "leaf").mapInPandas(at_home, f"{schema}, features array<double>, others array<long>"))
    questions = homes.select("row_id", "features", F.explode("others").alias("leaf"))
    asked = questions.groupBy("leaf").agg(F.count("*").alias("asked"))
    total = asked.agg(F.sum("asked")).first()[0] or 0
    if total > QUESTIONS * points.count():
        def nearest(left: Block, right: Block) -> pd.DataFrame:
            gaps, counts = smallest(left["features"], right["features"], right["n"], count)
            return pd.DataFrame({"row_id": left["row_id"], "gaps": list(gaps), "counts": list(counts)})

        return block_pairs(points.select(*names), points.select(*names), nearest, schema, large_blocks(points.count(), los.shape[1] + 2))

    def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                there, ids = unpacked(row, names), np.asarray(row["ids"])
                gaps, counts = smallest(np.asarray(row["x"], dtype=float).reshape(len(ids), -1), there["features"], there["n"], count)
                yield pd.DataFrame({"row_id": ids, "gaps": list(gaps), "counts": list(counts)})

    salted = questions.join(asked, "leaf").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.ceil(F.col("asked") / ASKING)))
    together = salted.groupBy("leaf", "salt").agg(F.collect_list(F.struct("row_id", "features")).alias("q"))
    together = together.select("leaf", "salt", F.col("q.row_id").alias("ids"), F.flatten("q.features").alias("x"))
    met = together.join(packed.select("leaf", *names), "leaf").repartition(max(1, min(len(keys), 2000)), "leaf", "salt")
    return homes.select("row_id", "gaps", "counts").unionByName(met.mapInPandas(away, schema))
