"""DBSCAN as joins over grid cells, exact in any dimension.

Copies of a point become one weighted point, and points are gathered into grid
cells whose diagonal is at most eps (Gan and Tao, 2015). That takes the hot
spots out of the pairwise work:

* a cell holding ``min_samples`` rows makes all its points core without
  comparing any of them, and all core points of a cell share a cluster;
* only points of cells below that size are counted against their neighbours;
* two cells are linked by their bounding boxes where those decide, and by ever
  finer boxes where they do not, so two crowded cells never meet point by point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.functions.blocks import Block, block_pairs, large_blocks
from starling.functions.ranks import with_dense_index
from starling.functions.sampling import broadcast_if_small, hash_sample
from starling.functions.vectors import dot, squared_distance, squared_distance_dims, total
from starling.operators.components import connected_components
from starling.operators.evaluate import label_counts
from starling.operators.hdbscan import forest
from starling.operators.moments import group_boxes
from starling.operators.prepare import width
from starling.session import cut_lineage

NOISE = -1
# Cells meet by at most this many measures, each of which leaves less than this share of the pairs.
GRID_DIMS = 3
PRUNES = 0.9
# Pivots, and the cells they are chosen from: a choice that only steers which pairs are compared.
PIVOTS, PIVOT_SAMPLE = 8, 1000
SPELLED_DIMS = 16
# More cells than this of many columns, of which the measures leave more than this share of the pairs, meet as blocks.
FEW_CELLS, MEETS = 4096, 0.05
# Pairs of points compared at a time, and how near eps, relative to the squares, a pair is measured again by direct differences.
TILE_PAIRS, CLOSE = 250_000, 1e-9
# The share of the blocks that points meet first which lack neighbours in their own.
FIRST_BLOCKS = 8
# Pairs of boxes are split further while one of them stands for more point pairs.
POINT_PAIRS = 250_000
SPLIT = 4
# Join keys holding more cells or points than this are split over salts.
CROWD = 50_000


@dataclass(frozen=True)
class DbscanFit:
    labels: DataFrame
    n_clusters: int
    n_noise: int
    noise_ratio: float


def dbscan(ff: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DbscanFit:
    """Labels as the sequential algorithm gives them.

    Distance <= eps counts, a row counts itself, clusters are numbered by their
    first core row, a border row joins its lowest-numbered neighbour cluster.
    """
    labels = cut_lineage(dbscan_labels(ff, eps, min_samples))
    counts = label_counts(labels).first()
    return DbscanFit(labels, counts["n_clusters"], counts["n_noise"], counts["noise_ratio"])


def dbscan_labels(ff: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """The feature frame with ``cluster`` added (-1 is noise)."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    dims = width(ff)
    points, cells = _points_and_cells(ff, dims, _cell_side(eps, dims))
    if dims > SPELLED_DIMS and cells.count() > FEW_CELLS and _keyed(cells, dims, eps)[3] > MEETS:
        placed = _labels_by_blocks(points.select(F.col("pid").alias("row_id"), "features", "weight"), dims, eps, min_samples)
        return ff.join(placed, "features").select(*ff.columns, "cluster")
    near = cut_lineage(_near_cells(cells, dims, eps))
    points = cut_lineage(_mark_core(points, near, dims, eps, min_samples))
    core_cells = cut_lineage(
        group_boxes(points.where("core"), ["cid", "cell"], dims, F.count("*").alias("n"), F.min("pid").alias("first_core"))
    )
    edges = _core_links(points.where("core"), core_cells, near, dims, eps)
    numbers = cut_lineage(_number_clusters(edges, core_cells))
    borders = _border_clusters(points, core_cells.join(numbers, "cid"), near, dims, eps)
    placed = (
        points.join(numbers, "cid", "left")
        .join(borders, "pid", "left")
        .select("features", F.when(F.col("core"), F.col("cluster")).otherwise(F.coalesce("border", F.lit(NOISE))).cast("int").alias("cluster"))
    )
    return ff.join(placed, "features").select(*ff.columns, "cluster")


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs are within eps: by one product, and by direct differences where that is too close to tell."""
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    over = x @ y.T
    over *= -2.0
    over += squares
    over -= eps * eps
    near = over <= 0.0
    squares += eps * eps
    squares *= CLOSE
    i, j = np.nonzero(np.abs(over, out=over) <= squares)
    if len(i):
        near[i, j] = _direct(x[i], y[j]) <= eps * eps
    return near


def _direct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - y[:, j]
        out += gap * gap
    return out


def _tiles(left: Block, right: Block, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of ``left``, some at a time, and which of ``right`` are within eps of them."""
    step = max(1, TILE_PAIRS // max(len(right["row_id"]), 1))
    for at in range(0, len(left["row_id"]), step):
        yield slice(at, at + step), _within(left["features"][at : at + step], right["features"], eps)


def _labels_by_blocks(points: DataFrame, dims: int, eps: float, min_samples: int) -> DataFrame:
    """``(features, cluster)`` where no cell can be told from another: blocks of points meet in tasks.

    Only counts, a few links for each pair of blocks and the borders' clusters leave the tasks, never pairs of points.
    Points that have enough neighbours in some blocks need no others to be core, and points of one component need no
    links among each other, so all blocks are met only by points that lack neighbours or lie outside the largest component.
    """
    points = cut_lineage(points.where("features IS NOT NULL"))
    id_type = points.schema["row_id"].dataType.simpleString()
    total = points.count()
    size = large_blocks(total, dims + 2)
    count = max(1, math.ceil(total / size))
    dealt = lambda turn: F.pmod(F.xxhash64("row_id", F.lit(turn)), F.lit(count))

    def neighbours(left: Block, right: Block) -> pd.DataFrame:
        rows = np.zeros(len(left["row_id"]), dtype=np.int64)
        for s, near in _tiles(left, right, eps):
            near[left["row_id"][s, None] == right["row_id"][None, :]] = False
            rows[s] = near.astype(float) @ right["weight"]
        return pd.DataFrame({"row_id": left["row_id"], "rows": rows})

    def own_block(block: pd.DataFrame) -> Block:
        features = np.array(block["features"].to_list(), dtype=float).reshape(len(block), -1)
        return {c: features if c == "features" else block[c].to_numpy() for c in block.columns}

    enough = F.col("rows") + F.col("weight") >= min_samples
    points = points.withColumn("block", dealt(0))
    at_home = points.groupBy("block").applyInPandas(lambda block: neighbours(*[own_block(block)] * 2), f"row_id {id_type}, rows long")
    points = cut_lineage(points.join(at_home.groupBy("row_id").agg(F.sum("rows").alias("rows")), "row_id").withColumn("core", enough).withColumn("rows", F.lit(0).cast("long")))
    first = math.ceil(count / FIRST_BLOCKS)
    for low, high in ((0, first), (first, count)) if count > 1 else ():
        lacking, others = points.where("not core").select("row_id", "features"), points.where(F.col("block").between(low, high - 1))
        if low < high and lacking.limit(1).count():
            counted = block_pairs(lacking, others.select("row_id", "features", "weight"), neighbours, f"row_id {id_type}, rows long", size)
            counted = counted.groupBy("row_id").agg(F.sum("rows").alias("more"))
            points = points.join(counted, "row_id", "left").withColumn("rows", F.col("rows") + F.coalesce("more", F.lit(0))).drop("more")
            points = cut_lineage(points.withColumn("core", F.col("core") | enough))
    core = points.where("core").select("row_id", "features")

    def links(left: Block, right: Block, twice: bool = False) -> pd.DataFrame:
        ends = [np.zeros(0, dtype=np.int64)] * 2
        if not twice or left["row_id"].min() <= right["row_id"].min():
            for s, near in _tiles(left, right, eps):
                i, j = np.nonzero(near & (left["comp"][s, None] != right["comp"][None, :]))
                ends = [np.concatenate([e, x]) for e, x in zip(ends, (left["comp"][s][i], right["comp"][j]))]
                kept = forest(*ends, np.zeros(len(ends[0])))
                ends = [e[kept] for e in ends]
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    def own_links(block: pd.DataFrame) -> pd.DataFrame:
        own = own_block(block)
        return links(*[own | {"comp": own["row_id"]}] * 2)

    # Linked inside their blocks first, dealt in two ways, most points of a component are one for the other blocks.
    ends = f"a {id_type}, b {id_type}"
    blocks_of = [core.withColumn("block", dealt(turn)) for turn in ((0, 1) if count > 1 else (0,))]
    inner = [c.groupBy("block").applyInPandas(own_links, ends) for c in blocks_of]
    inner = cut_lineage(inner[0] if count == 1 else inner[0].unionByName(inner[1]))
    nodes = core.select(F.col("row_id").alias("node"))
    parts = cut_lineage(connected_components(inner, nodes))
    if count > 1:
        core = cut_lineage(core.join(parts.select(F.col("node").alias("row_id"), F.col("component").alias("comp")), "row_id"))
        largest = core.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").first()
        rest = core.where(F.col("comp") != largest["comp"]) if largest else core
        if rest.limit(1).count():
            many = 2 * largest["n"] < core.count()
            outer = block_pairs(core if many else rest, core, lambda left, right: links(left, right, many), ends, size)
            parts = cut_lineage(connected_components(cut_lineage(inner.unionByName(outer.distinct())), nodes))
    order = with_dense_index(parts.select("component").distinct(), ["component"], "cluster")
    numbers = parts.join(order, "component").select(F.col("node").alias("row_id"), F.col("cluster").cast("int").alias("cluster"))
    core = cut_lineage(core.select("row_id", "features").join(numbers, "row_id"))

    def borders(left: Block, right: Block) -> pd.DataFrame:
        lowest = np.full(len(left["row_id"]), np.iinfo(np.int32).max, dtype=np.int32)
        for s, near in _tiles(left, right, eps):
            lowest[s] = np.where(near, right["cluster"][None, :], lowest[s, None]).min(axis=1)
        found = lowest < np.iinfo(np.int32).max
        return pd.DataFrame({"row_id": left["row_id"][found], "cluster": lowest[found]})

    outside = points.where("not core").select("row_id", "features")
    if not outside.limit(1).count():
        return core.select("features", "cluster")
    found = block_pairs(outside, core, borders, f"row_id {id_type}, cluster int", size).groupBy("row_id").agg(F.min("cluster").alias("cluster"))
    placed = outside.join(found, "row_id", "left").select("features", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
    return cut_lineage(core.select("features", "cluster").unionByName(placed))


def _cell_side(eps: float, dims: int) -> float:
    # A hair below eps / sqrt(d), so rounding cannot push a diagonal above eps.
    return eps / math.sqrt(dims) * (1 - 1e-9)


def _grid(side: float, dims: int) -> Column:
    return F.transform("features", lambda x: F.floor(x / F.lit(side)))


def _points_and_cells(ff: DataFrame, dims: int, side: float) -> tuple[DataFrame, DataFrame]:
    distinct = ff.groupBy("features").agg(F.min("row_id").alias("pid"), F.count("*").alias("weight"))
    distinct = cut_lineage(distinct.withColumn("cell", _grid(side, dims)))
    cells = cut_lineage(
        group_boxes(
            distinct, ["cell"], dims,
            F.min("pid").alias("cid"), F.sum("weight").alias("cell_rows"), F.count("*").alias("cell_points"),
        )
    )
    return distinct.join(cells.select("cell", "cid", "cell_rows", "cell_points"), "cell"), cells


def _box_gap(lo1, hi1, lo2, hi2, dims: int) -> Column:
    """Squared smallest distance between two boxes; folded over arrays where spelled out it would not compile."""
    if dims > SPELLED_DIMS:
        outside = F.zip_with(F.zip_with(lo2, hi1, lambda a, b: a - b), F.zip_with(lo1, hi2, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
        return dot(outside, outside)
    gaps = [F.greatest(F.col(lo2)[j] - F.col(hi1)[j], F.col(lo1)[j] - F.col(hi2)[j], F.lit(0.0)) for j in range(dims)]
    return total([g * g for g in gaps])


def _box_reach(lo1, hi1, lo2, hi2, dims: int) -> Column:
    """Squared largest distance between two boxes."""
    if dims > SPELLED_DIMS:
        across = F.zip_with(F.zip_with(hi2, lo1, lambda a, b: a - b), F.zip_with(hi1, lo2, lambda a, b: a - b), lambda a, b: F.greatest(a, b))
        return dot(across, across)
    spans = [F.greatest(F.col(hi2)[j] - F.col(lo1)[j], F.col(hi1)[j] - F.col(lo2)[j]) for j in range(dims)]
    return total([s * s for s in spans])


def _keyed(cells: DataFrame, dims: int, eps: float) -> tuple[DataFrame, list[str], float, float]:
    """Cells with bucket columns to meet by, their distances to the pivots ``to``, the buckets' width, and some share of pairs left.

    Neither a coordinate of a box's middle nor the middle's distance from a
    fixed pivot can differ by more than the middles' own distance, and middles
    of boxes within eps are at most ``width`` apart. So near boxes lie in equal
    or adjacent buckets of that width of each such measure. The measures that
    leave the fewest pairs are the keys; coordinates do in few dimensions,
    rings around pivots where coordinates do not separate.
    """
    half = F.zip_with("lo", "hi", lambda a, b: (b - a) / 2)
    cells = cut_lineage(cells.withColumns({"middle": F.zip_with("lo", "hi", lambda a, b: (a + b) / 2), "radius": F.sqrt(dot(half, half))}))
    step = (eps + 2 * (cells.agg(F.max("radius")).first()[0] or 0.0)) * (1 + 1e-9)
    pivots = _pivots(np.array([r["middle"] for r in hash_sample(cells.select("cid", "middle"), PIVOT_SAMPLE, key="cid")]))
    cells = cells.withColumn("to", F.array(*[F.sqrt(squared_distance(F.col("middle"), F.array(*map(F.lit, p.tolist())))) for p in pivots]))
    cells = cells.withColumn("buckets", F.transform(F.concat("middle", "to"), lambda x: F.floor(x / F.lit(step))))
    counts = cells.select(F.posexplode("buckets").alias("measure", "bucket")).groupBy("measure", "bucket").agg(F.count("*").cast("double").alias("n"))
    beside = F.lag("n").over(Window.partitionBy("measure").orderBy("bucket")), F.lag("bucket").over(Window.partitionBy("measure").orderBy("bucket"))
    met = F.col("n") * (F.col("n") + F.when(beside[1] == F.col("bucket") - 1, 2 * beside[0]).otherwise(0.0))
    left = counts.withColumn("met", met).groupBy("measure").agg(F.sum("met").alias("met"), F.sum("n").alias("n")).orderBy("met", "measure").limit(GRID_DIMS).collect()
    chosen = [r["measure"] for i, r in enumerate(left) if i == 0 or r["met"] < PRUNES * r["n"] ** 2]
    share = math.prod(r["met"] / r["n"] ** 2 for r in left if r["measure"] in chosen)
    keys = [f"c{i}" for i in range(len(chosen))]
    return cells.withColumns({k: F.col("buckets")[j] for k, j in zip(keys, chosen)}).drop("middle", "radius", "buckets"), keys, step, share


def _pivots(points: np.ndarray) -> np.ndarray:
    """Points far from each other, the first far from the first one given."""
    gap = ((points - points[0]) ** 2).sum(axis=1)
    chosen = [int(gap.argmax())]
    while len(chosen) < min(PIVOTS, len(points)):
        gap = ((points - points[chosen[-1]]) ** 2).sum(axis=1) if len(chosen) == 1 else np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    return points[chosen]


def candidates(ff: DataFrame, eps: float) -> DataFrame:
    """One row: the cells, the ordered pairs of cells that meet in the join, and those whose boxes are within eps."""
    dims = width(ff)
    _, cells = _points_and_cells(ff, dims, _cell_side(eps, dims))
    met, near = _near_cells(cells, dims, eps, count=True), _near_cells(cells, dims, eps)
    return cells.agg(F.count("*").alias("cells")).crossJoin(met.agg(F.count("*").alias("met"))).crossJoin(near.agg(F.count("*").alias("near")))


def _near_cells(cells: DataFrame, dims: int, eps: float, count: bool = False) -> DataFrame:
    """``(cid, other, lo, hi, cell_rows, cell_points of other)`` for boxes within eps; with ``count`` for all that meet.

    Candidates meet in an equi-join on buckets; the pivots and the boxes decide.
    """
    if not cells.limit(1).count():
        return cells.select("cid", F.col("cid").alias("other"), "lo", "hi", "cell_rows", "cell_points")
    cells, keys, step, _ = _keyed(cells, dims, eps)
    cells = cut_lineage(cells)
    moves = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = cells.select(F.col("cid").alias("other"), "lo", "hi", "cell_rows", "cell_points", "to", *keys)
    left = cells.select("cid", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("to").alias("to1"), *keys)
    for key in keys:
        left = left.withColumn("_m", F.explode(moves)).withColumn(key, F.col(key) + F.col("_m")).drop("_m")
    crowds = right.groupBy(*keys).agg(F.count("*").alias("_n"))
    if (crowds.agg(F.max("_n")).first()[0] or 0) > CROWD:
        crowded = cut_lineage(
            crowds.where(F.col("_n") > CROWD).select(*keys, F.ceil(F.col("_n") / CROWD).cast("int").alias("salts"))
        )
        # A crowded coarse cell becomes a square of (left, right) salt pairs.
        left = _salted(left, crowded, keys, "cid", "l_salt", "r_salt")
        right = _salted(right, crowded, keys, "other", "r_salt", "l_salt")
        keys = [*keys, "l_salt", "r_salt"]
    pairs = left.join(right, keys).where(F.col("cid") != F.col("other"))
    if not count:
        within = F.forall(F.zip_with("to1", "to", lambda a, b: F.abs(a - b) <= step), lambda near: near)
        pairs = pairs.where(within).where(_box_gap("lo1", "hi1", "lo", "hi", dims) <= eps * eps)
    return pairs.select("cid", "other", "lo", "hi", "cell_rows", "cell_points")


def _salted(side: DataFrame, crowded: DataFrame, keys: list[str], key: str, own: str, other: str) -> DataFrame:
    """Give rows of crowded keys one salt of their own and a copy per partner salt."""
    marked = side.join(broadcast_if_small(crowded, len(keys) + 1), keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return marked.withColumns({
        own: F.pmod(F.xxhash64(key), F.col("salts")).cast("int"),
        other: F.explode(F.sequence(F.lit(0), F.col("salts") - 1)),
    }).drop("salts")


def _point_pairs(reach: DataFrame, points: DataFrame, dims: int, eps: float) -> DataFrame:
    """Reach rows with each point of the other cell that lies within eps.

    A crowded cell's points are split over salts by their number, so no single
    task meets all of them.
    """
    salts = F.ceil(F.col("cell_points") / CROWD).cast("int")
    asking = reach.where("not whole").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("cell_points", "weight")
    asked = points.select(
        F.col("cid").alias("other"), "features", "weight", F.pmod(F.xxhash64("pid"), salts).cast("int").alias("salt")
    )
    return asking.join(asked, ["other", "salt"]).where(
        squared_distance_dims(F.col("x"), F.col("features"), dims) <= eps * eps
    )


def _reachable(points: DataFrame, boxes: DataFrame, dims: int, eps: float) -> DataFrame:
    """Points with each nearby box (joined on cid), and whether all of it is in reach."""
    x = points.withColumnRenamed("features", "x").join(boxes, "cid")
    square = F.lit(eps * eps)
    return (
        x.where(_box_gap("x", "x", "lo", "hi", dims) <= square)
        .withColumn("whole", _box_reach("x", "x", "lo", "hi", dims) <= square)
    )


def _mark_core(points: DataFrame, near: DataFrame, dims: int, eps: float, min_samples: int) -> DataFrame:
    dense = points.where(F.col("cell_rows") >= min_samples)
    sparse = points.where(F.col("cell_rows") < min_samples)
    reach = _reachable(sparse.select("pid", "features", "cid"), near.withColumnRenamed("cell_rows", "rows"), dims, eps)
    reach = cut_lineage(reach.select("pid", "x", "other", "whole", "rows", "cell_points"))
    one_by_one = _point_pairs(reach.drop("rows"), points, dims, eps).select("pid", F.col("weight").alias("rows"))
    own = sparse.select("pid", F.col("cell_rows").alias("rows"))
    core = (
        reach.where("whole").select("pid", "rows").unionByName(one_by_one).unionByName(own)
        .groupBy("pid").agg(F.sum("rows").alias("rows"))
        .select("pid", (F.col("rows") >= min_samples).alias("core"))
    )
    columns = ["pid", "features", "weight", "cell", "cid", "cell_points", "core"]
    return dense.withColumn("core", F.lit(True)).select(*columns).unionByName(sparse.join(core, "pid").select(*columns))


def _core_links(core: DataFrame, core_cells: DataFrame, near: DataFrame, dims: int, eps: float) -> DataFrame:
    """Edges ``(a, b)`` between cells that have core points within eps of each other."""
    square = eps * eps
    side = _cell_side(eps, dims)

    def box(frame, cid, i):
        return frame.select(
            F.col("cid").alias(cid), F.col("cell").alias(f"key{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}"), F.col("n").alias(f"n{i}")
        )

    pairs = near.where("cid < other").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    pairs = pairs.join(box(core_cells, "a", 1), "a").join(box(core_cells, "b", 2), "b")
    links = None
    level = 0
    while True:
        decided = cut_lineage(
            pairs.where(_box_gap("lo1", "hi1", "lo2", "hi2", dims) <= square)
            .withColumn("linked", _box_reach("lo1", "hi1", "lo2", "hi2", dims) <= square)
            .select("a", "b", "key1", "key2", "n1", "n2", "linked")
        )
        found = decided.where("linked").select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
        open_pairs = decided.where("not linked").join(found, ["a", "b"], "left_anti")
        largest = open_pairs.agg(F.max(F.col("n1") * F.col("n2")).alias("m")).first()["m"]
        if largest is None:
            return links
        level += 1
        finer = side / SPLIT**level
        children = (
            core.join(
                open_pairs.select(F.col("a").alias("cid")).unionByName(open_pairs.select(F.col("b").alias("cid"))).distinct(),
                "cid", "left_semi",
            )
            .withColumn("parent", _grid(finer * SPLIT, dims))
        )
        if largest <= POINT_PAIRS:
            left = children.select(F.col("cid").alias("a"), F.col("parent").alias("key1"), F.col("features").alias("x"))
            right = children.select(F.col("cid").alias("b"), F.col("parent").alias("key2"), F.col("features").alias("y"))
            found = (
                open_pairs.select("a", "b", "key1", "key2").join(left, ["a", "key1"]).join(right, ["b", "key2"])
                .where(squared_distance_dims(F.col("x"), F.col("y"), dims) <= square)
                .select("a", "b").distinct()
            )
            return links.unionByName(found)
        boxes = cut_lineage(
            group_boxes(children.withColumn("cell", _grid(finer, dims)), ["cid", "parent", "cell"], dims, F.count("*").alias("n"))
        )

        def child(cid, i):
            return box(boxes, cid, i).join(
                boxes.select(F.col("cid").alias(cid), F.col("cell").alias(f"key{i}"), F.col("parent").alias(f"parent{i}")), [cid, f"key{i}"]
            )

        pairs = (
            open_pairs.select("a", "b", F.col("key1").alias("parent1"), F.col("key2").alias("parent2"))
            .join(child("a", 1), ["a", "parent1"]).join(child("b", 2), ["b", "parent2"])
        )


def _number_clusters(edges: DataFrame, core_cells: DataFrame) -> DataFrame:
    """``(cid, cluster)``: components in the order of their first core row."""
    parts = connected_components(edges, core_cells.select(F.col("cid").alias("node"))).withColumnRenamed("node", "cid")
    parts = cut_lineage(parts)
    firsts = (
        parts.join(core_cells.select("cid", "first_core"), "cid").groupBy("component").agg(F.min("first_core").alias("first"))
    )
    order = with_dense_index(firsts, ["first"], "cluster")
    return parts.join(order.select("component", "cluster"), "component").select("cid", "cluster")


def _border_clusters(points: DataFrame, clusters: DataFrame, near: DataFrame, dims: int, eps: float) -> DataFrame:
    """``(pid, border)``: lowest cluster with a core point within eps."""
    outside = points.where("not core").select("pid", "features", "cid")
    at_home = outside.join(clusters.select("cid", "cluster"), "cid").select("pid", "cluster")
    boxes = near.select("cid", "other", "cell_points").join(clusters.select(F.col("cid").alias("other"), "lo", "hi", "cluster"), "other")
    reach = cut_lineage(_reachable(outside, boxes, dims, eps).select("pid", "x", "other", "whole", "cluster", "cell_points"))
    one_by_one = _point_pairs(reach, points.where("core"), dims, eps).select("pid", "cluster")
    return (
        reach.where("whole").select("pid", "cluster").unionByName(one_by_one).unionByName(at_home)
        .groupBy("pid").agg(F.min("cluster").alias("border"))
    )
