"""K-means: fitting, fixed-start Lloyd rounds, assignment, elbow."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.functions.blocks import block_pairs, distances
from starling.functions.vectors import hash_uniform, squared_distance_to
from starling.operators.cells import Tally, packed
from starling.operators.moments import group_moments, within_squares
from starling.operators.prepare import width

CENTER_SCHEMA = "cluster int, center array<double>"
# Centres are shipped to every task only up to this many numbers (16 MB).
SHIPPED_VALUES = 2_000_000
# Up to this many terms distances are plain compiled arithmetic.
UNROLL_TERMS = 256
# Candidates for starting centres: rounds over all rows, and rows wanted per round for each centre.
START_ROUNDS, START_FACTOR = 4, 4
VALUES_PER_TASK = 2_000_000
# Rows that are compared with one run's centres at a time, so that their distances stay in a core's cache.
FOLD_ROWS = 2048
# Distances to starting candidates that are held at a time.
GAPS = 32_768
# Rows are packed by neighbourhood if so many of them meet so many centres per round, in no more columns than boxes separate.
PACKED_ROWS, PACKED_CENTERS, PACKED_DIMS = 50_000, 200, 8


def centers_frame(spark: SparkSession, centers: Sequence[Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], CENTER_SCHEMA)


def small_centers(centers: DataFrame) -> tuple[list[int], list[list[float]]] | None:
    """Labels and coordinates on the driver, or None when they exceed the bound."""
    centers = centers.select("cluster", "center").persist()
    try:
        size = centers.agg(F.sum(F.size("center")).alias("v")).first()["v"] or 0
        if size > SHIPPED_VALUES:
            return None
        rows = sorted(centers.collect(), key=lambda r: r["cluster"])
    finally:
        centers.unpersist()
    return [r["cluster"] for r in rows], [list(r["center"]) for r in rows]


def assign(ff: DataFrame, centers: DataFrame) -> DataFrame:
    """Add ``cluster`` and ``distance`` of the nearest centre (ties: lowest label)."""
    local = small_centers(centers)
    if local is None:
        return _assign_many(ff, centers)
    return _assign_small(ff, *local)


def _assign_small(ff: DataFrame, labels: Sequence[int], points: Sequence[Sequence[float]]) -> DataFrame:
    if not points:
        raise ValueError("no centres given")
    if len(points) * len(points[0]) <= UNROLL_TERMS:
        names = F.array(*[F.lit(int(c)) for c in labels])
        squares = F.array(*[squared_distance_to(F.col("features"), p) for p in points])
        return (
            ff.withColumn("_d", squares)
            .withColumn("_m", F.array_min("_d"))
            .withColumn("cluster", F.element_at(names, F.array_position("_d", F.col("_m")).cast("int")))
            .withColumn("distance", F.sqrt("_m"))
            .drop("_d", "_m")
        )
    matrix, ids = np.asarray(points, dtype=float), np.asarray(labels, dtype="int32")

    @F.pandas_udf("cluster int, distance double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        x, step = np.stack(features.to_numpy()), max(1, 1_000_000 // len(matrix))
        best, least = np.empty(len(x), dtype=int), np.empty(len(x))
        for at in range(0, len(x), step):
            squares = distances(x[at : at + step], matrix, squared=True)
            best[at : at + step] = squares.argmin(axis=1)
            least[at : at + step] = squares.min(axis=1)
        return pd.DataFrame({"cluster": ids[best], "distance": np.sqrt(least)})

    return ff.withColumn("_n", nearest("features")).select(
        *ff.columns, F.col("_n.cluster").alias("cluster"), F.col("_n.distance").alias("distance")
    )


def _assign_many(ff: DataFrame, centers: DataFrame) -> DataFrame:
    """More centres than may be shipped: compare bounded blocks with each other."""

    def nearest(left, right):
        order = np.argsort(right["row_id"])
        squares = distances(left["features"], right["features"][order], squared=True)
        best = squares.argmin(axis=1)
        return pd.DataFrame({
            "row_id": left["row_id"], "d2": squares[np.arange(len(best)), best], "cluster": right["row_id"][order][best]
        })

    id_type = ff.schema["row_id"].dataType.simpleString()
    found = block_pairs(
        ff.select("row_id", "features"),
        centers.select(F.col("cluster").alias("row_id"), F.col("center").alias("features")),
        nearest,
        f"row_id {id_type}, d2 double, cluster int",
    )
    best = found.groupBy("row_id").agg(F.min(F.struct("d2", "cluster")).alias("b"))
    return ff.join(
        best.select("row_id", F.col("b.cluster").alias("cluster"), F.sqrt("b.d2").alias("distance")), "row_id"
    )


def kmeans_lloyd(
    ff: DataFrame, init: DataFrame, iters: int, tol: float | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """Lloyd rounds from given centres: (assigned rows, centres, rounds done).

    A round is one pass with a k-row aggregate; an empty cluster keeps its
    centre. ``tol`` stops early once no centre moved farther.
    """
    local = small_centers(init)
    if local is None:
        raise ValueError(f"more than {SHIPPED_VALUES} centre values")
    labels, points = local
    dims = len(points[0])
    done = 0
    for done in range(1, iters + 1):
        means = {
            r["cluster"]: list(r["center"])
            for r in group_moments(_assign_small(ff, labels, points), dims=dims).select("cluster", "center").collect()
        }
        updated = [means.get(c, p) for c, p in zip(labels, points)]
        moved = max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(points, updated))
        points = updated
        if tol is not None and moved <= tol:
            break
    frame = ff.sparkSession.createDataFrame(list(zip(labels, points)), CENTER_SCHEMA)
    return _assign_small(ff, labels, points), frame, done


def first_distinct_rows(ff: DataFrame, k: int) -> DataFrame:
    """Deterministic start: the k distinct points with the lowest row ids."""
    points = ff.groupBy("features").agg(F.min("row_id").alias("row_id")).orderBy("row_id").limit(k).collect()
    return centers_frame(ff.sparkSession, [r["features"] for r in points])


@dataclass(frozen=True)
class KMeansFit:
    labels: DataFrame
    centers: DataFrame
    inertia: float
    n_iter: int
    n_clusters: int


def kmeans(
    ff: DataFrame, k: int = 3, max_iter: int = 300, tol: float = 1e-4, n_init: int = 10, seed: int = 42
) -> KMeansFit:
    """Best of ``n_init`` k-means++ starts; clusters numbered by centre order."""
    cost, points, n_iter = fit_each_k(ff, [k], max_iter, tol, n_init, seed)[k]
    return KMeansFit(
        labels=_assign_small(ff, range(len(points)), points),
        centers=centers_frame(ff.sparkSession, points),
        inertia=cost,
        n_iter=n_iter,
        n_clusters=len(points),
    )


def fit_each_k(
    ff: DataFrame, ks: Sequence[int], max_iter: int = 300, tol: float = 1e-4, n_init: int = 10, seed: int = 42
) -> dict[int, tuple[float, list[list[float]], int]]:
    """(inertia, sorted centres, rounds) per k.

    All starts of all k share their passes: a round scans the rows once, moves
    every run that has not settled, and brings back k x d sums per run.
    """
    data, packs = ff.select("row_id", "features").persist(), None
    try:
        dims, n = width(data), data.count()
        if not n:
            raise ValueError("no rows to cluster")
        # Few rows make few tasks: a round over little data is all task overhead.
        tasks = max(1, n * dims * (1 + n_init * sum(ks)) // VALUES_PER_TASK)
        held, cores = data.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism
        if held < min(tasks, cores):
            # Many runs over few partitions: deal the rows out once, for all rounds.
            dealt = data.repartition(min(tasks, cores)).persist()
            dealt.count()
            data.unpersist()
            data, held = dealt, min(tasks, cores)
        rows = data.select("features").coalesce(tasks)
        tasks = min(tasks, held)
        sums, counts, _ = _round(rows, tasks, {0: np.zeros((1, dims))}, np.zeros(dims))[0]
        middle = sums[0] / counts[0]
        _, _, scatter = _round(rows, tasks, {0: np.zeros((1, dims))}, middle)[0]
        if not np.isfinite(scatter):
            raise ValueError("features hold missing or infinite values")
        spread = scatter / (n * dims)
        tally = None
        if n >= PACKED_ROWS and n_init * sum(ks) >= PACKED_CENTERS and dims <= PACKED_DIMS:
            packs, tasks = packed(data, n, middle)
            rows, tally = packs.persist(), Tally
        candidates, weights = _start_candidates(data, rows, tasks, n, max(ks), middle, scatter, seed, tally)
        if packs is not None:
            data.unpersist()
        runs = [(k, _plus_plus(candidates, weights, k, np.random.default_rng(seed + i))) for k in ks for i in range(n_init)]
        centers = [start - middle for _, start in runs]
        rounds = [0] * len(runs)
        moving = set(range(len(runs)))
        for _ in range(max_iter):
            if not moving:
                break
            for i, (sums, counts, _) in _round(rows, tasks, {i: centers[i] for i in moving}, middle, tally).items():
                moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers[i])
                shift = float(((moved - centers[i]) ** 2).sum())
                if not np.isfinite(shift):
                    raise ValueError("centres are not finite: features hold missing or infinite values")
                centers[i], rounds[i] = moved, rounds[i] + 1
                if shift <= tol * spread:
                    moving.discard(i)
        costs = {i: cost for i, (_, _, cost) in _round(rows, tasks, dict(enumerate(centers)), middle, tally).items()}
    finally:
        data.unpersist()
        if packs is not None:
            packs.unpersist()
    best = {}
    for k in ks:
        i = min((i for i, (run_k, _) in enumerate(runs) if run_k == k), key=lambda i: (costs[i], i))
        points = sorted((centers[i] + middle).tolist())
        best[k] = (costs[i], points, rounds[i])
    return best


def _start_candidates(data: DataFrame, rows: DataFrame, tasks: int, n: int, k: int, middle: np.ndarray, scatter: float, seed: int, tally: type[Tally] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows to draw starting centres from, and how many rows are nearest to each.

    k-means|| (Bahmani et al., 2012) over all rows: a row joins with a chance in
    proportion to its squared distance from the candidates so far, by a hash of
    its id. While distinct points are too few for k, the farthest row joins.
    """
    dims = len(middle)
    first = data.select("features", hash_uniform(seed, F.col("row_id"), F.lit("start")).alias("u")).orderBy("u").first()
    candidates = np.array([first["features"]], dtype=float)
    cost = max(scatter, 0.0) + n * float(((candidates[0] - middle) ** 2).sum())
    for turn in range(START_ROUNDS + k):
        if turn >= START_ROUNDS and len(candidates) >= k:
            break
        near = data.sparkSession.sparkContext.broadcast(candidates)

        @F.arrow_udf("double")
        def gap(features: pa.Array) -> pa.Array:
            x, step = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), dims), max(1, GAPS // len(near.value))
            out = np.empty(len(x))
            for at in range(0, len(x), step):
                out[at : at + step] = distances(x[at : at + step], near.value, squared=True).min(axis=1)
            return pa.array(out)

        measured = data.select("features", gap("features").alias("gap"), hash_uniform(seed, F.col("row_id"), F.lit("start"), F.lit(turn)).alias("u"))
        if turn < START_ROUNDS:
            # By the rule some START_FACTOR x k rows are expected, however many there are.
            measured = measured.where(F.col("u") * cost < F.col("gap") * (START_FACTOR * k))
            found = [r["features"] for r in measured.select("features").collect()]
        else:
            top = measured.agg(F.max_by("features", F.struct("gap", "u")).alias("f"), F.max("gap").alias("gap")).first()
            if not top["gap"]:
                break
            found = [top["f"]]
        if found:
            candidates = np.unique(np.vstack([candidates, np.array(found, dtype=float).reshape(-1, dims)]), axis=0)
        if turn + 1 < START_ROUNDS:
            cost = _round(rows, tasks, {0: candidates - middle}, middle, tally)[0][2]
    _, counts, _ = _round(rows, tasks, {0: candidates - middle}, middle, tally)[0]
    return candidates[counts > 0], counts[counts > 0]


def _plus_plus(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ (Arthur and Vassilvitskii, 2007) on weighted points; fewer centres if points run out."""
    chosen = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    gap = ((candidates - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and (gap * weights).sum() > 0:
        chosen.append(candidates[rng.choice(len(candidates), p=gap * weights / (gap * weights).sum())])
        gap = np.minimum(gap, ((candidates - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _round(
    data: DataFrame, tasks: int, centers: dict[int, np.ndarray], middle: np.ndarray, tally: type[Tally] | None = None
) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per run: sums of the rows by nearest centre, their counts, and the cost.

    Each task folds its rows into one small table per run before the shuffle;
    with ``tally`` the data are packs of rows.
    """
    result: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    dims = len(middle)
    batch: dict[int, np.ndarray] = {}
    for i, points in [*centers.items(), (-1, None)]:
        if points is None or (sum(len(p) for p in batch.values()) + len(points)) * dims > SHIPPED_VALUES:
            if batch:
                result.update(_shared_pass(data, tasks, batch, middle, tally))
            batch = {}
        if points is not None:
            batch[i] = points
    return result


def _shared_pass(data, tasks, centers, middle, tally):
    dims = len(middle)
    stacked = np.vstack(list(centers.values()))
    ends = np.cumsum([len(p) for p in centers.values()])
    slices = [(i, end - len(p), end) for (i, p), end in zip(centers.items(), ends)]
    # Squared distance less a row's own length, as one product with (row, 1).
    products = [(np.column_stack([-2.0 * p, (p**2).sum(axis=1)]), low, high) for p, (_, low, high) in zip(centers.values(), slices)]

    def cells(table, costs):
        rows, columns = np.nonzero(table)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rows, np.arange(len(slices))]), pa.int32()),
                pa.array(np.concatenate([columns, np.full(len(slices), -1)]), pa.int32()),
                pa.array(np.concatenate([table[rows, columns], costs])),
            ],
            ["row", "position", "value"],
        )

    def fold(batches):
        if tally is not None:
            counted = tally(stacked, ends)
            for batch in batches:
                counted.add(batch)
            yield cells(counted.table[:-1].T, np.add.reduceat(counted.table[-1], [low for _, low, _ in slices]))
            return
        table = np.zeros((len(stacked), dims + 1))
        costs = np.zeros(len(slices))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for at in range(0, len(values), FOLD_ROWS):
                x = np.column_stack([values[at : at + FOLD_ROWS] - middle, np.ones(min(FOLD_ROWS, len(values) - at))])
                own, turned = (x[:, :dims] ** 2).sum(axis=1), np.ascontiguousarray(x.T)
                for s, (product, low, high) in enumerate(products):
                    closeness = product @ turned
                    least = closeness.min(axis=0)
                    nearest = closeness == least
                    if np.count_nonzero(nearest) > len(x):  # ties: the lowest centre
                        nearest = closeness.argmin(axis=0) == np.arange(high - low)[:, None]
                    table[low:high] += nearest.astype(float) @ x
                    costs[s] += np.maximum(own + least, 0.0).sum()
        yield cells(table, costs)

    folded = data.mapInArrow(fold, "row int, position int, value double")
    # Bounded by the centres: (d + 1) values per centre and a cost per run. The
    # tables of very few tasks are added up right here instead of in a shuffle.
    if tasks * stacked.size > SHIPPED_VALUES:
        folded = folded.groupBy("row", "position").agg(F.sum("value").alias("value"))
    found = folded.toArrow()
    row, position, value = (np.asarray(found.column(c)) for c in ("row", "position", "value"))
    table, costs = np.zeros((len(stacked), dims + 1)), np.zeros(len(slices))
    inner = position >= 0
    np.add.at(table, (row[inner], position[inner]), value[inner])
    np.add.at(costs, row[~inner], value[~inner])
    return {i: (table[low:high, :dims], table[low:high, dims], float(costs[s])) for s, (i, low, high) in enumerate(slices)}


def inertia(labelled: DataFrame, dims: int | None = None) -> DataFrame:
    """One row: sum of squared distances of the rows to their own cluster's mean."""
    return within_squares(group_moments(labelled, dims=dims)).agg(F.sum("ss").alias("inertia"))


def elbow_costs(ff: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42) -> DataFrame:
    """Cost per k, all k fitted over the same passes: ``(k, inertia)``."""
    best = fit_each_k(ff, list(ks), n_init=n_init, seed=seed)
    return ff.sparkSession.createDataFrame([(k, cost) for k, (cost, _, _) in best.items()], "k int, inertia double")


def knee(costs: DataFrame, compat: bool = False) -> DataFrame:
    """One row ``k``: the largest second difference of the cost curve.

    The difference is centred on the middle of three costs. ``compat=True``
    reports one less, as code that counts from the first cost does. With fewer
    than three costs the answer is 2. The cost table holds one row per k.
    """
    # One row per candidate k, so a single ordered pass is enough.
    order = Window.orderBy("k")
    bend = F.lead("inertia").over(order) - 2 * F.col("inertia") + F.lag("inertia").over(order)
    bends = costs.select(F.col("k").cast("long").alias("k"), bend.alias("bend")).where("bend is not null")
    chosen = F.max_by(F.col("k"), F.struct("bend", -F.col("k")))
    return bends.agg(F.coalesce(chosen - (1 if compat else 0), F.lit(2)).cast("long").alias("k"))


def elbow(ff: DataFrame, max_k: int = 20, n_init: int = 10, seed: int = 42) -> tuple[int, DataFrame]:
    """(chosen k, cost table) over k = 2 .. min(max_k, n // 2)."""
    top = max(2, min(max_k, ff.count() // 2))
    costs = elbow_costs(ff, range(2, top + 1), n_init=n_init, seed=seed)
    return min(max(knee(costs).first()["k"], 2), top), costs


__all__ = [
    "KMeansFit", "assign", "centers_frame", "elbow", "elbow_costs", "first_distinct_rows", "fit_each_k",
    "inertia", "kmeans", "kmeans_lloyd", "knee", "small_centers", "width",
]
