import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.operators import spectral


@pytest.mark.parametrize("dims, gamma", [(2, 1.0), (2, 7.0), (1, 0.3)])
def test_boxes_carry_the_affinity_to_rounding_error(spark, monkeypatch, dims, gamma):
    rng = np.random.RandomState(4)
    x = np.vstack([rng.uniform(-1.5, 1.5, (200, dims)), rng.uniform(18, 21, (100, dims)), np.zeros((1, dims)), np.ones((1, dims))])
    y = rng.normal(size=(len(x), 3))
    frame = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id long, features array<double>, y array<double>")
    boxes = spectral._occupied(frame, gamma)
    monkeypatch.setattr(spectral, "block_pairs", lambda *_: pytest.fail("all pairs of points meet"))
    found = np.array([r["product"] for r in spectral._affinity_times(frame, "y", 3, gamma, boxes).orderBy("row_id").collect()])
    dense = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)) @ y
    assert np.abs(found - dense).max() < 1e-11


def test_odd_or_scattered_points_meet_in_pairs(spark, monkeypatch):
    frame = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "row_id long, features array<double>")
    assert len(spectral._occupied(frame, 1.0)) == 30
    assert spectral._occupied(frame.withColumn("features", F.array(F.lit(float("nan")), F.lit(0.0))), 1.0) is None
    assert spectral._occupied(frame.withColumn("features", F.array(*[F.lit(0.0)] * 3)), 1.0) is None
    monkeypatch.setattr(spectral, "MAX_BOXES", 20)
    assert spectral._occupied(frame, 1.0) is None
