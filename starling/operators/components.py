"""Connected components of an undirected graph, as alternating star steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.session import cut_lineage

MAX_ROUNDS = 100
# A graph of at most this many edges is settled in one small step.
SMALL_GRAPH_EDGES = 100_000


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)`` where the component is its smallest node.

    ``edges`` has columns ``a, b`` (any order, duplicates allowed), ``nodes``
    a column ``node``. Beyond a small, checked size large-star and small-star steps (Kiveris et al., 2014)
    shrink every component to a star in a logarithmic number of rounds. Each
    round's edges are written to the shared folder, so the plan stays short
    and a lost executor costs one round at most.
    """
    stars = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stars = _settle_small(stars) if stars.count() <= SMALL_GRAPH_EDGES else settle_by_rounds(stars)
    return nodes.select("node").join(
        stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left"
    ).select("node", F.coalesce("component", "node").alias("component"))


def _settle_small(edges: DataFrame) -> DataFrame:
    """Stars of a graph whose checked size fits the driver."""
    rows = edges.toPandas()
    ids, ends = np.unique(rows[["u", "v"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(ids))
    while True:
        low = label[ends].min(axis=1)
        hooked = label.copy()
        np.minimum.at(hooked, label[ends[:, 0]], low)
        np.minimum.at(hooked, label[ends[:, 1]], low)
        hooked = hooked[hooked]
        if (hooked == label).all():
            break
        label = hooked
    stars = pd.DataFrame({"u": ids, "v": ids[label]})
    return edges.sparkSession.createDataFrame(stars[stars.u != stars.v], edges.schema)


def settle_by_rounds(stars: DataFrame) -> DataFrame:
    """Stars ``(u, v)``, ``v`` the smallest node of u's component, from edges ``u > v``."""
    signature = _signature(stars)
    for _ in range(MAX_ROUNDS):
        stars = cut_lineage(_small_star(_large_star(stars)))
        previous, signature = signature, _signature(stars)
        if signature == previous:
            return stars
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def _signature(edges: DataFrame):
    """Changes whenever the edge set changes (a star step never adds edges back)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest."""
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = directed.groupBy("u").agg(F.min("v").alias("m"))
    moved = directed.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = lowest.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where("u <> v").distinct()
