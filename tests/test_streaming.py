import numpy as np
import pytest

from starling.operators.kmeans import assign, centers_frame
from starling.operators.scale import fit_scaler
from starling.sources.store import CenterModel
from starling.streaming.scoring import StreamingCenters, minibatch_kmeans_stream, score_stream, write_stream
from tests.conftest import COLUMNS, matrix_of
from tests.test_clustering import KNOWN_CENTERS


@pytest.fixture()
def source(spark, golden, tmp_path):
    path = str(tmp_path / "in")
    golden.repartition(3).write.parquet(path)
    return lambda: spark.readStream.schema(golden.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_scores_equal_batch_scores(spark, golden, source, tmp_path):
    model = CenterModel(fit_scaler(golden, COLUMNS), centers_frame(spark, KNOWN_CENTERS))
    scored = score_stream(source(), model, "row_id")
    for _ in range(2):  # the second start finds nothing new to do
        write_stream(scored, str(tmp_path / "out"), str(tmp_path / "progress"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").collect()
    assert got == model.predict(golden, "row_id").orderBy("row_id").collect()


def test_centres_follow_the_stream(spark, golden, source, tmp_path):
    scaler = fit_scaler(golden, COLUMNS)
    model = CenterModel(scaler, centers_frame(spark, KNOWN_CENTERS))
    running, state = minibatch_kmeans_stream(
        source(), lambda batch: model.features(batch, "row_id"), model.centers, str(tmp_path / "state"), str(tmp_path / "progress"), True
    )
    running.awaitTermination()
    rows = state.latest().orderBy("cluster").collect()
    assert sum(r["n"] for r in rows) == 300
    assert np.abs(np.array([r["center"] for r in rows]) - np.array(KNOWN_CENTERS)).max() < 0.3


def test_a_replayed_batch_counts_once(spark, golden_ff, tmp_path):
    state = StreamingCenters(spark, str(tmp_path / "state"))
    state.start(centers_frame(spark, KNOWN_CENTERS))
    state.update(golden_ff, 0)
    first = state.latest().orderBy("cluster").collect()
    state.update(golden_ff, 0)
    assert state.latest().orderBy("cluster").collect() == first
    state.update(golden_ff, 1)
    x, c = matrix_of(golden_ff), np.array([r["center"] for r in first])
    near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    for r in state.latest().collect():
        n = first[r["cluster"]]["n"]
        mine = x[near == r["cluster"]]
        assert r["n"] == n + len(mine)
        assert r["center"] == pytest.approx((c[r["cluster"]] * n + mine.sum(0)) / (n + len(mine)))
    assert assign(golden_ff, state.latest().select("cluster", "center")).count() == 300
