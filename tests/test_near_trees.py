"""Spanning trees and merges found through the leaves of a k-d tree instead of all pairs of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions import space
from starling.operators import dbscan, hdbscan, hierarchical, linkage
from tests.conftest import frame_of, labels_of
from tests.test_clustering import brute_dbscan


def refuse(*args, **kwargs):
    raise AssertionError("all pairs of blocks meet")


@pytest.mark.parametrize("kind", ["groups", "grid", "uneven"])
def test_spanning_tree_without_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = {
        "groups": np.vstack([rng.uniform(0, 1, (150, 2)) + c for c in ([0, 0], [0, 30], [40, 0])] + [[[200.0, 7.0]]]),
        "grid": np.array([[i, j] for i in range(20) for j in range(18)], dtype=float),  # all edges tie
        "uneven": np.exp(rng.normal(0, 2, (400, 2))),
    }[kind]
    core = rng.uniform(0, 0.2, len(x)) if kind != "grid" else np.zeros(len(x))
    cores = spark.createDataFrame([(i, float(c)) for i, c in enumerate(core)], "row_id long, core double")
    points = frame_of(spark, x).join(F.broadcast(cores), "row_id").persist()
    expected = hdbscan.prim(np.arange(len(x)), x, core).sort_values(["gap", "a", "b"], ignore_index=True)
    monkeypatch.setattr(space, "LEAF_ROWS", 32)
    monkeypatch.setattr(hdbscan, "FEW_POINTS", 0, raising=False)
    monkeypatch.setattr(hdbscan, "block_pairs", refuse)
    got = hdbscan.tree_edges(points).orderBy("gap", "a", "b").toPandas()
    assert (got[["a", "b"]].to_numpy() == expected[["a", "b"]].to_numpy()).all()
    assert (got["gap"] == expected["gap"]).all()


@pytest.mark.parametrize("kind", ["groups", "uneven"])
def test_ward_without_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(6)
    x = {
        "groups": np.vstack([rng.uniform(0, 1, (100, 2)) + c for c in ([0, 0], [0, 3], [4, 0])]),
        "uneven": np.exp(rng.normal(0, 1, (300, 2))),
    }[kind]
    ff = frame_of(spark, x).persist()
    expected = [labels_of(hierarchical.hierarchical(ff, k).labels) for k in (3, 7)]
    monkeypatch.setattr(space, "LEAF_ROWS", 32)
    monkeypatch.setattr(hierarchical, "LOCAL_CLUSTERS", 100)
    monkeypatch.setattr(hierarchical, "block_pairs", refuse)
    for k, labels in zip((3, 7), expected):
        assert (labels_of(hierarchical.hierarchical(ff, k).labels) == labels).all()


@pytest.mark.parametrize("kind", ["average", "complete"])
def test_linkage_rounds_within_leaves(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.uniform(0, 1, (100, 2)) + c for c in ([0, 0], [0, 3], [4, 0])])
    ff = frame_of(spark, x).persist()
    expected = [labels_of(hierarchical.hierarchical(ff, k, linkage=kind).labels) for k in (3, 7)]
    monkeypatch.setattr(linkage, "LEAF_POINTS", 40, raising=False)
    monkeypatch.setattr(linkage, "LOCAL_CLUSTERS", 120)
    monkeypatch.setattr(linkage, "_merged", refuse)
    for k, labels in zip((3, 7), expected):
        assert (labels_of(hierarchical.hierarchical(ff, k, linkage=kind).labels) == labels).all()


def test_dbscan_by_blocks_where_nothing_separates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.vstack([x, x[:40], x[:40]])
    x[10] = x[11] + np.eye(20)[0] * 0.75
    ff = frame_of(spark, x)
    monkeypatch.setattr(dbscan, "FEW_CELLS", 0, raising=False)
    monkeypatch.setattr(dbscan, "TILE_PAIRS", 3000, raising=False)
    monkeypatch.setattr(dbscan, "_near_cells", refuse)
    for eps, least in ((0.95, 3), (0.8, 3)):
        assert (labels_of(dbscan.dbscan_labels(ff, eps, least)) == brute_dbscan(x, eps, least)).all()


def test_dbscan_meets_all_blocks_only_where_points_need_them(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 20)) * 0.1
    lone = np.vstack([x, x[:1] + np.eye(20)[0] * 3, np.full((60, 20), 9.0) + rng.normal(size=(60, 20)) * 0.1])
    monkeypatch.setattr(dbscan, "FEW_CELLS", 0)
    monkeypatch.setattr(dbscan, "MEETS", 0.0)
    monkeypatch.setattr(dbscan, "large_blocks", lambda rows, width: 60)
    assert (labels_of(dbscan.dbscan_labels(frame_of(spark, lone), 0.9, 4)) == brute_dbscan(lone, 0.9, 4)).all()
    monkeypatch.setattr(dbscan, "block_pairs", refuse)
    assert (labels_of(dbscan.dbscan_labels(frame_of(spark, x), 0.9, 4)) == brute_dbscan(x, 0.9, 4)).all()


def test_leaves_stay_alike_where_only_the_first_levels_are_shifted():
    x = np.random.default_rng(10).uniform(0, 1, (20_000, 2))
    rows = np.bincount(space.planes(x[:4000], 7, 0.64, 2).leaf(x))
    assert rows.max() < 4 * len(x) / 128


@pytest.mark.parametrize("rows, heavy", [(10**3, 1), (10**6, 3), (10**8, 5000)])
def test_folded_distances_are_exact_sums(rows, heavy):
    rng = np.random.default_rng(11)
    x, n, root = rng.uniform(0, 5, (900, 2)), rng.integers(1, heavy + 1, 900), np.sort(rng.integers(0, 20, 900))
    root[:300] = 0
    bits = 62 - 2 * int(np.ceil(np.log2(rows + 1)))
    measure = linkage.Measure("average", 2.0**-48, min(26, bits), -(-52 // min(26, bits)))
    block, at = linkage._sorted({"root": root, "features": x, "n": n})
    parts = linkage._folded(block, at, block, at, measure)
    steps = np.floor(linkage.distances(x, x) / measure.unit).astype(np.int64).astype(object) * (n[:, None] * n[None, :])
    expected = np.add.reduceat(np.add.reduceat(steps, at, axis=0), at, axis=1)
    assert (sum(p.astype(object) << (measure.bits * (len(parts) - 1 - i)) for i, p in enumerate(parts)) == expected).all()
    assert all(p.max() < 1 << measure.bits for p in parts[1:])  # one form for equal sums


def test_corners_keep_what_is_farthest(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(300, 2)), [[20.0 + i, 20.0 + j] for i in range(15) for j in range(20)]])
    members = spark.createDataFrame([(i, 300 * (i // 300), a.tolist()) for i, a in enumerate(x)], "id long, root long, features array<double>")
    kept = np.array(sorted(r["id"] for r in linkage._corners(members).collect()))
    assert len(kept) < 120 and {0, 300} <= set(kept)
    for own in (x[:300], x[300:]):
        mine = x[kept[(kept < 300) == (own[0, 0] < 10)]]
        assert (linkage.distances(x, own).max(axis=1) == linkage.distances(x, mine).max(axis=1)).all()
