from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from starling.operators.kmeans import centers_frame
from starling.sources.log import EventLog, Folder
from starling.sources.store import Store
from starling.streaming.scoring import StreamingCenters
from tests.test_clustering import KNOWN_CENTERS

SCHEMA = "id long, what string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"e{i}") for i in ids], SCHEMA)


def ids_of(log):
    return sorted(r["id"] for r in log.read().collect())


def test_a_name_is_claimed_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "names"))
    assert folder.names() == []
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: folder.claim("0"), range(40))) == 1
    assert folder.names() == ["0"]


def test_an_empty_log_has_rows_of_its_schema(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA)
    assert log.read().columns == ["id", "what", "log_version"] and log.read().count() == 0
    assert log.versions() == [] and log.compact() == []
    log.append(spark.createDataFrame([], SCHEMA))
    assert log.read().count() == 0


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    logs = [EventLog(spark, path, SCHEMA, every=3) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(lambda i: logs[i % 4].append(rows(spark, 2 * i, 2 * i + 1)), range(14)))
    assert sorted(taken) == list(range(14)) == logs[0].versions()
    assert ids_of(logs[0]) == list(range(28))
    of_version = {r["log_version"]: sorted(r["ids"]) for r in logs[0].read().groupBy("log_version").agg(F.collect_list("id").alias("ids")).collect()}
    assert of_version == {v: [2 * i, 2 * i + 1] for i, v in enumerate(taken)}
    assert "block-0" in Folder(spark, f"{path}/commits").names()
    assert not {"log_version=0", "log_version=1", "log_version=2"} & set(Folder(spark, f"{path}/rows").names())


def test_dead_writers_are_not_seen_and_late_ones_are(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA, every=2)
    late = log._take()
    assert [log.append(rows(spark, i)) for i in (1, 2, 3)] == [1, 2, 3]
    assert ids_of(log) == [1, 2, 3] and Folder(spark, f"{log.path}/blocks").names().count("block=0") == 0
    assert log.compact(abandoned=True) == [0]
    assert ids_of(log) == [1, 2, 3]
    rows(spark, 0).write.parquet(f"{log.path}/rows/log_version={late}")
    assert ids_of(log) == [1, 2, 3]
    log._commits.claim(str(late))
    assert ids_of(log) == [0, 1, 2, 3]
    for i in range(4, 8):
        log.append(rows(spark, i))
    assert ids_of(log) == list(range(8)) and log.versions() == list(range(8))


def test_the_last_change_of_an_id_wins_whatever_the_clocks_say(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    model = store.save_model_metadata("a", "kmeans", model_id="m")
    assert store.get_model_metadata(model)["status"] == "ready"
    assert store.delete_model(model) and store.list_models().count() == 0
    store.save_model_metadata("a2", "kmeans", model_id="m")
    assert store.list_models().first()["name"] == "a2" and "version" in store.list_models().columns


def test_streaming_centres_keep_the_newest_versions(spark, golden_ff, tmp_path):
    state = StreamingCenters(spark, str(tmp_path / "state"), keep=2)
    state.start(centers_frame(spark, KNOWN_CENTERS))
    for batch in range(3):
        state.update(golden_ff, batch)
    assert state.versions() == [1, 2]
    first = state.latest().orderBy("cluster").collect()
    state.update(golden_ff, 2)
    assert state.latest().orderBy("cluster").collect() == first and sum(r["n"] for r in first) == 900
    Folder(spark, f"{state.path}/batch=3").claim("half")
    assert state.versions() == [1, 2]
    with pytest.raises(ValueError, match="no centres"):
        state.before(1)
