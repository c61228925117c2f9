import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.plans.registry import ALGORITHMS, registry_frame, validate
from starling.plans.run import prepare_features, quick, run, run_batch
from starling.session import release_scratch, scratch_path, shared_dir
from starling.sources import generate
from starling.sources.store import Store, write_labels
from starling.sources.tables import list_files, read_table
from starling.operators import report
from tests.conftest import COLUMNS


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_formats(spark, golden, tmp_path):
    for suffix in ("csv", "json", "parquet"):
        path = str(tmp_path / f"t.{suffix}")
        writer = golden.write.option("header", True)
        getattr(writer, suffix)(path)
        assert read_table(spark, path).select(*COLUMNS).count() == 300
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_table(spark, str(tmp_path / "rows.json"), multiline=True).count() == 2
    with pytest.raises(ValueError, match="Unsupported file format"):
        read_table(spark, "t.xlsx")


def test_file_listing_keeps_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,s\n1,2.5,a\n2,3.5,b\n")
    (tmp_path / "b.parquet").write_text("not a table")
    (tmp_path / "c.txt").write_text("ignored")
    rows = {r["filename"]: r for r in list_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.csv", "b.parquet"}
    assert (rows["a.csv"]["n_rows"], rows["a.csv"]["n_numeric"], rows["a.csv"]["size"]) == (2, 2, 22)
    assert rows["b.parquet"]["error"] == "Could not read file"


def test_datasets(store, golden):
    assert store.list_datasets().count() == 0
    dataset = store.save_dataset(golden, "golden", {"kind": "sample"})
    assert store.load_dataset(dataset).count() == 300
    found = store.get_dataset(dataset)
    assert (found["name"], found["n_rows"], found["metadata"]) == ("golden", 300, {"kind": "sample"})
    assert store.load_dataset("missing") is None


def test_experiments_keep_one_id_and_the_last_state(store):
    first = store.start_experiment("kmeans", "a.csv", {"n_clusters": 3})
    second = store.start_experiment("dbscan", "b.csv")
    store.complete_experiment(first, "r1", {"n_clusters": 3, "silhouette_score": 0.45678})
    store.fail_experiment(second, "no numeric columns")
    rows = {r["id"]: r for r in store.list_experiments().collect()}
    assert len(rows) == 2
    assert rows[first]["status"] == "completed" and rows[first]["parameters"] == {"n_clusters": "3"}
    assert rows[first]["started_at"] <= rows[first]["completed_at"]
    assert rows[second]["error"] == "no numeric columns" and store.get_experiment("x") is None
    shown = {r["id"]: r for r in report.experiment_history(store.list_experiments()).collect()}
    assert (shown[first]["clusters"], shown[first]["score"]) == (3, 0.457)
    assert shown[second]["clusters"] is None and len(shown[first]["date"]) == 16
    counts = report.status_counts(store.list_experiments()).first()
    assert (counts["total"], counts["completed"], counts["failed"]) == (2, 1, 1)
    page, total = report.page(store.list_experiments(), [F.desc("recorded_at")], limit=1)
    assert total == 2 and page.first()["id"] == second


def test_models_can_be_deleted(store):
    kept = store.save_model_metadata("a", "kmeans", metrics={"silhouette_score": 0.5})
    gone = store.save_model_metadata("b", "dbscan")
    assert store.delete_model(gone) and not store.delete_model(gone)
    assert [r["id"] for r in store.list_models().collect()] == [kept]
    assert store.get_model_metadata(gone) is None
    assert store.load_model("missing") is None


def test_run_stores_results_and_predicts(spark, store, golden, tmp_path):
    result = run(golden, "kmeans", id_col="row_id", n_clusters=3, n_init=3, store=store, source_name="golden")
    assert result.metrics["silhouette_score"] == pytest.approx(0.4533, abs=3e-4)
    assert result.feature_names == COLUMNS
    saved = store.load_results(result.results_id)
    assert saved["assignments"].count() == 300 and saved["centers"].count() == 3
    assert store.results_summary(result.results_id).first()["n_features"] == 5
    assert store.get_experiment(result.experiment_id)["results_id"] == result.results_id
    assert store.load_results("missing") is None
    assert (saved["data_rows"], saved["processed_columns"]) == (300, 5) and saved["data_columns"] >= 5
    for r in saved["centers"].collect():
        back = [c * s + m for c, s, m in zip(r["center"], result.scaler.divisors, result.scaler.centers)]
        assert np.allclose(r["center_raw"], back)
    store.export_results(result.results_id, golden, "row_id", str(tmp_path / "out.csv"))
    out = read_table(spark, str(tmp_path / "out.csv"))
    assert out.columns == [*golden.columns, "cluster"] and out.count() == 300
    write_labels(result.labels, str(tmp_path / "labels"))
    store.save_model(result.model(), "m")
    again = store.load_model("m").predict(golden, "row_id")
    assert again.join(result.labels, ["row_id", "cluster"]).count() == 300
    raw = store.load_model("m").centers_raw().first()
    assert raw["center_raw"] == pytest.approx(result.scaler.inverse_point(raw["center_scaled"]))


@pytest.mark.parametrize("algorithm, parameters", [
    ("dbscan", {"eps": 0.8}), ("hierarchical", {}), ("spectral", {"n_clusters": 3, "n_init": 2}),
    ("hdbscan", {"min_cluster_size": 10}), ("deep_embedding", {"n_clusters": 3, "latent_dim": 2, "rounds": 1, "n_init": 2}),
])
def test_every_algorithm_runs(golden, algorithm, parameters):
    result = run(golden, algorithm, id_col="row_id", check_parameters=False, **parameters)
    assert result.labels.count() == 300 and result.labels.select("row_id").distinct().count() == 300
    assert {"n_clusters", "n_samples", "silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"} <= set(result.metrics)


def test_failures_are_recorded(spark, store, golden):
    with pytest.raises(ValueError, match="Unknown algorithm"):
        run(golden, "invalid_algorithm", id_col="row_id", store=store)
    row = store.list_experiments().first()
    assert row["status"] == "failed" and "Unknown algorithm" in row["error"]
    with pytest.raises(ValueError, match="No numeric columns"):
        run(spark.createDataFrame([("a",)], "s string"), "kmeans", n_clusters=2)
    with pytest.raises(ValueError, match="impute them first"):
        run(spark.createDataFrame([(1, None), (2, 1.0)], "i long, x double"), "kmeans", id_col="i", strategy=None, n_clusters=2)


def test_tables_without_a_key_get_stable_ids(golden):
    ff, names, _, id_col, source = prepare_features(golden.drop("row_id"))
    assert id_col == "row_id" and names == COLUMNS
    joined = source.join(ff, "row_id")
    assert joined.count() == 300 and joined.select("row_id").distinct().count() == 300


def test_quick_and_reduced_runs(golden):
    assert quick(golden, id_col="row_id", n_init=2).metrics["n_clusters"] == 3
    reduced = run(golden, "kmeans", id_col="row_id", n_clusters=3, n_components=2, n_init=2, exclude=["feature_5"])
    assert len(reduced.labels.first()["features"]) == 2 and "feature_5" not in reduced.feature_names


def test_batch_keeps_going(golden):
    small = golden.select("row_id", "feature_1", "feature_2")
    summary = run_batch({"a": small}, ["hierarchical", "nothing"], id_col="row_id").collect()
    assert [(r["algorithm"], r["error"] is None) for r in summary] == [("hierarchical", True), ("nothing", False)]
    assert summary[0]["metrics"]["n_clusters"] == 3.0


def test_registry(spark):
    assert validate("kmeans", {}) == {"n_clusters": 8, "max_iter": 300, "tol": 1e-4}
    assert validate("hdbscan", {"min_samples": 3})["min_samples"] == 3
    for algorithm, given in [("kmeans", {"n_clusters": 1}), ("dbscan", {"eps": 3.0}), ("dbscan", {"min_samples": 2.5}),
                             ("kmeans", {"k": 3}), ("nope", {}), ("hierarchical", {"linkage": "median"})]:
        with pytest.raises(ValueError):
            validate(algorithm, given)
    assert registry_frame(spark).select("algorithm").distinct().count() == len(ALGORITHMS)


def test_generators_do_not_depend_on_partitioning(spark):
    ids = spark.range(200).withColumnRenamed("id", "row_id")
    makers = [
        lambda i: generate.gen_blobs(spark, i, 3, 4, missing_rate=0.1),
        lambda i: generate.gen_three_clusters(spark, i),
        lambda i: generate.gen_classification(spark, i, 6, 3, 2, 3),
        lambda i: generate.gen_mixed(spark, i, 4, 2, 2),
        lambda i: generate.gen_timeseries(spark, i, 6),
    ]
    for make in makers:
        assert make(ids.repartition(1)).orderBy("row_id").collect() == make(ids.repartition(7)).orderBy("row_id").collect()
    blobs = generate.gen_blobs(spark, 100, 10, 3)
    assert blobs.count() == 100 and blobs.select("true_label").distinct().count() == 3
    wide = generate.widen(blobs, [f"feature_{j}" for j in range(10)])
    assert wide.columns == ["row_id", "true_label", *[f"feature_{j}" for j in range(10)]]


def test_generators_deal_few_partitions_over_the_cores(spark):
    ids = spark.range(50).withColumnRenamed("id", "row_id").repartition(1)
    frame = generate.gen_timeseries(spark, ids)
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    walk = next(r for r in frame.collect() if r["true_label"] == 3)["series"]
    assert len(walk) == 50 and len({round(b - a, 12) for a, b in zip(walk, walk[1:])}) > 40


def test_scratch_can_be_released(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    release_scratch(spark)
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_wide_tables_are_reduced(spark, golden):
    result = run(golden, "kmeans", id_col="row_id", n_clusters=3, n_init=2, max_dimensions=2)
    assert len(result.labels.first()["features"]) == 2 and result.details["pca"] is not None
    assert "pca" not in run(golden, "kmeans", id_col="row_id", n_clusters=3, n_init=2).details
