"""The condensed tree of a spanning tree: clusters of at least a given number of rows, and what falls out of them.

Edges are taken in the order of (gap, a, b). A component below the size merges
next along its lightest outgoing edge, whatever the others do, so components
that choose the same edge merge in rounds, all over the tree at once, until they
reach the size. What is left then either falls into a cluster along the edge it
chose, or is an edge on which two clusters meet. Points stay in tables; only
clusters, at most two for each ``min_cluster_size`` rows, are held in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.sampling import broadcast_if_small
from starling.operators.components import connected_components
from starling.session import cut_lineage

NOISE = -1
# A cluster is given up for its parts only if they are more stable by more than rounding.
ROUNDING = 1e-12
# Rounds stop when at most this many edges touch a component below the size; one task takes these in order.
LOCAL_EDGES = 500_000
_KEY = ["gap", "a", "b"]


@dataclass(frozen=True)
class Parts:
    """``home``: (node, seed, rows, gap, a, b) of each point, the last three its component's edge into the tree
    (null if its component is a cluster by itself); ``births``: (seed, rows, gap); ``meetings``: (gap, a, b, u, v)
    between seeds.
    """

    home: DataFrame
    births: DataFrame
    meetings: DataFrame


def contract(edges: DataFrame, points: DataFrame, min_cluster_size: int) -> Parts:
    """Split a spanning tree ``(gap, a, b)`` of ``points`` (row_id, n, core) at the places where clusters meet."""
    rows = points.select("row_id", "n")
    state = edges
    for end, node in (("u", "a"), ("v", "b")):
        state = state.join(rows.select(F.col("row_id").alias(node), F.col("n").alias(f"r{end}")), node).withColumn(end, F.col(node))
    state = cut_lineage(state.select(*_KEY, "u", "v", "ru", "rv"))
    size, merged, settled = F.lit(float(min_cluster_size)), None, False
    while not settled:
        active = state.where((F.col("ru") < size) | (F.col("rv") < size))
        settled = active.count() <= LOCAL_EDGES
        if settled:
            merges = cut_lineage(active.coalesce(1).mapInPandas(_merged_in_order(min_cluster_size), "low long, high long, rows double, gap double"))
        else:
            both = _choices(state, size).groupBy("e").agg(F.count("*").alias("chosen"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("rows").alias("rows"))
            merges = cut_lineage(both.where("chosen = 2").select("low", "high", "rows", "e.gap"))
        if not merges.limit(1).count():
            break
        merged = merges if merged is None else merged.unionByName(merges)
        names = merges.select(F.explode(F.array("low", "high")).alias("comp"))
        names = connected_components(merges.select(F.col("low").alias("a"), F.col("high").alias("b")), names.distinct().withColumnRenamed("comp", "node"))
        now = merges.groupBy("low").agg(F.max("rows").alias("now"))
        names = cut_lineage(names.join(now, F.col("component") == F.col("low")).select("node", F.col("component").alias("to"), "now"))
        for end in ("u", "v"):
            state = state.join(broadcast_if_small(names.withColumnRenamed("node", end), 3), end, "left").withColumns(
                {end: F.coalesce("to", F.col(end)), f"r{end}": F.coalesce("now", F.col(f"r{end}"))}
            ).drop("to", "now")
        state = cut_lineage(state.where("u <> v"))
    picks = cut_lineage(_choices(state, size).select("comp", "rows", "e.*"))
    nodes = points.select(F.col("row_id").alias("node"))
    heavy = points.where(F.col("n") >= size).select(F.col("row_id").alias("seed"), F.col("n").alias("rows"), F.col("core").alias("gap"))
    if merged is None:
        owner, births = nodes.withColumn("comp", F.col("node")), cut_lineage(heavy)
    else:
        owner = cut_lineage(connected_components(merged.select(F.col("low").alias("a"), F.col("high").alias("b")), nodes).withColumnRenamed("component", "comp"))
        births = cut_lineage(heavy.unionByName(merged.where(F.col("rows") >= size).select(F.col("low").alias("seed"), "rows", "gap")))
    # A component's chosen edge leads into one with a lighter choice, or into a cluster: each tree of choices holds one cluster.
    fallen = cut_lineage(state.join(broadcast_if_small(picks.select(*_KEY, F.lit(True).alias("fell")), 4), _KEY, "left"))
    comps = births.select(F.col("seed").alias("node")).unionByName(picks.select(F.col("comp").alias("node")))
    trees = cut_lineage(connected_components(fallen.where("fell").select(F.col("u").alias("a"), F.col("v").alias("b")), comps))
    seeds = births.select(F.col("seed").alias("node"), "seed").join(trees, "node").select("component", "seed")
    placed = cut_lineage(trees.join(seeds, "component").select(F.col("node").alias("comp"), "seed"))
    meetings = fallen.where("fell IS NULL").select(*_KEY, "u", "v")
    for end in ("u", "v"):
        meetings = meetings.join(placed.select(F.col("comp").alias(end), "seed"), end).drop(end).withColumnRenamed("seed", end)
    home = owner.join(placed, "comp").join(picks, "comp", "left").select("node", "seed", "rows", *_KEY, "comp")
    return Parts(cut_lineage(home), births, cut_lineage(meetings))


def _choices(state: DataFrame, size) -> DataFrame:
    """``(comp, e, rows)``: the lightest edge of each component below the size."""
    ends = [state.where(F.col(f"r{e}") < size).select(F.col(e).alias("comp"), F.col(f"r{e}").alias("rows"), *_KEY) for e in ("u", "v")]
    return ends[0].unionByName(ends[1]).groupBy("comp").agg(F.min(F.struct(*_KEY)).alias("e"), F.max("rows").alias("rows"))


def _merged_in_order(min_cluster_size: int):
    """The merges of components below the size, edge by edge in rising order: what the rounds come to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat(list(batches), ignore_index=True).sort_values(_KEY, ignore_index=True)
        rows = dict(zip(edges["u"], edges["ru"])) | dict(zip(edges["v"], edges["rv"]))
        top = {c: c for c in rows}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        merges = []
        for gap, u, v in zip(edges["gap"].tolist(), edges["u"].tolist(), edges["v"].tolist()):
            low, high = sorted((find(u), find(v)))
            together = rows[low] + rows[high]
            small = rows[low] < min_cluster_size, rows[high] < min_cluster_size
            if any(small):
                top[high], rows[low] = low, together
            if all(small):
                merges.append((low, high, together, gap))
        yield pd.DataFrame(merges, columns=["low", "high", "rows", "gap"]).astype({"low": "int64", "high": "int64", "rows": float, "gap": float})

    return run


@dataclass(frozen=True)
class Dendrogram:
    """Clusters: seeds first, then one for each meeting in rising order.

    ``parent`` is one beyond the last for the last; ``made`` is a cluster's
    meeting, -1 for seeds; ``levels`` the level at which a cluster meets another.
    """

    seeds: np.ndarray
    parent: np.ndarray
    made: np.ndarray
    levels: np.ndarray
    keys: pd.DataFrame

    @staticmethod
    def of(seeds: np.ndarray, meetings: pd.DataFrame) -> Dendrogram:
        meetings = meetings.sort_values(_KEY, ignore_index=True)
        count = len(seeds)
        u, v = np.searchsorted(seeds, meetings["u"]).tolist(), np.searchsorted(seeds, meetings["v"]).tolist()
        top, find = list(range(count)), list(range(count))
        parent = np.full(count + len(meetings), count + len(meetings))

        def root(i: int) -> int:
            while find[i] != i:
                find[i] = find[find[i]]
                i = find[i]
            return i

        for m, (x, y) in enumerate(zip(u, v)):
            x, y = root(x), root(y)
            parent[top[x]] = parent[top[y]] = count + m
            find[y] = x
            top[x] = count + m
        made = np.concatenate([np.full(count, -1), np.arange(len(meetings))])
        levels = np.array([level(g) for g in meetings["gap"]] + [0.0])
        return Dendrogram(seeds, parent, made, levels, meetings[_KEY])

    @property
    def birth(self) -> np.ndarray:
        """The level at which each cluster meets another, 0 for the last."""
        return self.levels[self.parent - len(self.seeds)]

    def holders(self, places: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The cluster that holds seed number ``places`` when ``before`` meetings are done."""
        last = len(self.parent)
        up = [np.append(self.parent, last)]
        while (up[-1] != last).any():
            up.append(up[-1][up[-1]])
        made, at = np.append(self.made, last), places.copy()
        for step in reversed(up):
            higher = step[at]
            at = np.where(made[higher] < before, higher, at)
        return at

    def meetings_before(self, gap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many meetings come before each edge."""
        own = len(self.keys)
        key = np.rec.fromarrays([np.concatenate([self.keys[c], x]) for c, x in zip(_KEY, (gap, a, b))], names=_KEY)
        order = np.lexsort((key["b"], key["a"], key["gap"]))
        done = np.cumsum(order < own)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = done
        return rank[own:]


def level(gap: float) -> float:
    return 1.0 / gap if gap > 0 else math.inf


def _members(parts: Parts, tree: Dendrogram, highest: float) -> pd.DataFrame:
    """Rows that are a cluster's own and the sum of their levels, by cluster."""
    shared = parts.home.sparkSession.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            before = own.meetings_before(b["gap"].to_numpy(), b["a"].to_numpy(), b["b"].to_numpy())
            yield pd.DataFrame({"cluster": own.holders(np.searchsorted(own.seeds, b["seed"]), before), "rows": b["rows"], "gap": b["gap"]})

    fallen = parts.home.where("gap IS NOT NULL").groupBy("comp").agg(*(F.first(c).alias(c) for c in ("seed", "rows", *_KEY))).select("seed", "rows", *_KEY)
    # A cluster's first points are its own from the start: before every meeting.
    start = parts.births.mapInPandas(_numbered(shared), "cluster long, rows double, gap double")
    levels = F.when(F.col("gap") > 0, F.least(1.0 / F.col("gap"), F.lit(highest))).otherwise(highest)
    members = start.unionByName(fallen.mapInPandas(placed, "cluster long, rows double, gap double"))
    # Sums of decimals do not depend on the order of the rows.
    mass = F.sum((levels * F.col("rows")).cast("decimal(38,15)")).cast("double")
    return members.groupBy("cluster").agg(F.sum("rows").alias("rows"), mass.alias("mass")).toPandas()


def _numbered(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cluster": np.searchsorted(shared.value.seeds, b["seed"]), "rows": b["rows"], "gap": b["gap"]})

    return run


def condense(edges: DataFrame, points: DataFrame, min_cluster_size: int) -> tuple[DataFrame, list[float], float]:
    """``(row_id, cluster)`` of the most stable clusters, their persistence, and the rows that are noise.

    A copied point with enough rows is a cluster by itself, from its core
    level on. Clusters are numbered by their smallest point.
    """
    parts = contract(edges, points, min_cluster_size)
    levels = parts.births.select("gap").unionByName(parts.home.select("gap")).where("gap IS NOT NULL")
    smallest = levels.agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("positive"), F.min("gap").alias("gap")).first()
    highest = 1.0 / smallest["positive"] if smallest["positive"] else 1.0
    # One row per cluster from here on.
    seeds = np.sort(parts.births.select("seed").toPandas()["seed"].to_numpy())
    tree = Dendrogram.of(seeds, parts.meetings.toPandas())
    own = _members(parts, tree, highest)
    count, last = len(tree.parent), len(tree.parent) - 1
    rows, mass = np.zeros(count + 1), np.zeros(count + 1)
    rows[own["cluster"]], mass[own["cluster"]] = own["rows"], own["mass"]
    birth = tree.birth
    stability, below, chosen = mass[:count] - rows[:count] * birth, np.zeros(count + 1), np.zeros(count, dtype=bool)
    parents = tree.parent.tolist()
    for c in range(count):  # parts come before what they form
        p = parents[c]
        chosen[c] = c != last and not stability[c] < below[c] * (1 - ROUNDING)
        below[p] += stability[c] if chosen[c] else below[c]
        rows[p] += rows[c]
        if p < count:
            stability[p] += (birth[c] - birth[p]) * rows[c]
    holder = np.full(count + 1, NOISE)
    for c in range(last, -1, -1):
        p = parents[c]
        holder[c] = holder[p] if holder[p] != NOISE else c if chosen[c] else NOISE
    place = holder[: len(seeds)]
    in_cluster = place != NOISE
    ends = tree.parent[place[in_cluster]] - len(seeds)
    held = pd.DataFrame({"seed": seeds[in_cluster], "held": place[in_cluster]}).join(
        tree.keys.iloc[ends].reset_index(drop=True).rename(columns={c: f"end_{c}" for c in _KEY})
    )
    spark = points.sparkSession
    names = spark.createDataFrame(held, "seed long, held long, end_gap double, end_a long, end_b long")
    inside = F.col("gap").isNull() | (F.struct(*_KEY) < F.struct(*(F.col(f"end_{c}").alias(c) for c in _KEY)))
    found = cut_lineage(parts.home.join(broadcast_if_small(names, 5), "seed", "left").select("node", F.when(inside, F.col("held")).alias("held")))
    order = [r["held"] for r in found.where("held IS NOT NULL").groupBy("held").agg(F.min("node").alias("first")).orderBy("first").collect()]
    numbers = spark.createDataFrame([(int(h), c) for c, h in enumerate(order)], "held long, cluster int")
    labels = found.join(broadcast_if_small(numbers, 2), "held", "left").select(F.col("node").alias("row_id"), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
    top = highest if smallest["gap"] else math.inf
    shares = [float(stability[h] / (rows[h] * top)) if 0 < top < math.inf else 1.0 for h in order]
    return labels, shares, float(rows[last] - sum(rows[h] for h in order))
