import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions import blocks, space
from starling.operators import hdbscan


def points_frame(spark, x, n=None):
    n = np.ones(len(x)) if n is None else n
    return spark.createDataFrame([(i, row.tolist(), float(w)) for i, (row, w) in enumerate(zip(x, n))], "row_id long, features array<double>, n double")


def plain_core(x, n, wanted):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    order = np.argsort(gaps, axis=1, kind="stable")
    reached = (np.cumsum(n[order], axis=1) >= wanted).argmax(axis=1)
    return np.take_along_axis(gaps, order, axis=1)[np.arange(len(x)), reached]


@pytest.mark.parametrize("case", ["blobs", "copies", "wide"])
def test_core_distances_meet_near_leaves_only(spark, monkeypatch, case):
    monkeypatch.setattr(space, "LEAF_ROWS", 16)
    monkeypatch.setattr(space, "LEAF_MOST", 32)
    monkeypatch.setattr(space, "ASKING", 8)
    paired = []
    monkeypatch.setattr(space, "block_pairs", lambda *a: paired.append(1) or blocks.block_pairs(*a))
    rng = np.random.RandomState(1)
    x = np.vstack([rng.normal(mean, 0.5, (120, 2)) for mean in ((0, 0), (9, 9), (0, 9))] + [rng.uniform(-40, 40, (12, 2))])
    if case == "copies":
        x[:200] = x[0]
    if case == "wide":
        monkeypatch.setattr(space, "QUESTIONS", 2)
        x = rng.normal(size=(150, 24))
    n = rng.randint(1, 4, len(x)).astype(float)
    found = hdbscan.with_core_distances(points_frame(spark, x, n), 7).orderBy("row_id").collect()
    assert [r["core"] for r in found] == pytest.approx(plain_core(x, n, 8), abs=1e-12)
    assert bool(paired) == (case == "wide") or case == "copies"


def test_core_distances_without_rows(spark):
    empty = points_frame(spark, np.zeros((0, 2)))
    assert hdbscan.with_core_distances(empty, 5).count() == 0
    one = points_frame(spark, np.zeros((1, 2)))
    assert [r["core"] for r in hdbscan.with_core_distances(one, 5).collect()] == [0.0]


def test_large_blocks_bound_the_copies():
    assert blocks.large_blocks(100, 2) == blocks.BLOCK_ROWS
    assert blocks.large_blocks(1_200_000, 2) * blocks.FEW_BLOCKS >= 1_200_000
    assert blocks.large_blocks(10**9, 64) * 64 <= blocks.BLOCK_VALUES
