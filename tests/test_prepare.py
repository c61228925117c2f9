import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions.quantiles import exact_quantiles
from starling.functions.ranks import with_dense_index
from starling.operators import prepare, profile, reduce, scale
from tests.conftest import COLUMNS, frame_of, matrix_of


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(1, 1.0, "a"), (2, 2.0, "b"), (3, None, "b"), (4, float("nan"), None), (5, 3.0, "a"), (6, 4.0, None)]
    return spark.createDataFrame(rows, "id long, x double, s string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_numeric_columns_leave_out_booleans_and_text(spark):
    df = spark.createDataFrame([(1, True, "a", 2.0)], "i int, b boolean, s string, d double")
    assert prepare.numeric_columns(df) == ["i", "d"]
    assert prepare.numeric_columns(df, exclude=["i"]) == ["d"]
    with pytest.raises(ValueError, match="No numeric columns"):
        prepare.select_numeric(df.select("s", "b"))
    features, target = prepare.split_target(df, "d")
    assert features.columns == ["i"] and target.columns == ["d"]


def test_imputation_treats_nan_as_missing(gappy):
    assert column(prepare.impute(gappy, "mean"), "x")[2:4] == [2.5, 2.5]
    assert column(prepare.impute(gappy, "median"), "x")[2:4] == [2.5, 2.5]
    # Smallest of the tied values, for numbers and for text.
    filled = prepare.impute(gappy, "mode")
    assert column(filled, "x")[2:4] == [1.0, 1.0]
    assert column(filled, "s")[3] == "a"
    with pytest.raises(ValueError):
        prepare.impute(gappy, "guess")


def test_mode_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, None)], "id long, x double, s string")
    row = prepare.impute(empty, "mode").first()
    assert row["x"] == 0 and row["s"] == "Unknown"


def test_missing_values_must_be_imputed_first(gappy):
    with pytest.raises(ValueError, match="impute them first"):
        prepare.require_complete(gappy, ["x"])


def test_missing_report_order(gappy):
    rows = profile.missing_report(gappy).collect()
    assert [(r["column_name"], r["missing_count"]) for r in rows] == [("x", 2), ("s", 2), ("id", 0)]
    assert rows[0]["missing_percent"] == pytest.approx(100 / 3)


def test_standard_scaling_is_population_based(golden):
    values = np.array(scale.fit_scaler(golden, COLUMNS).transform(golden).select(*COLUMNS).collect())
    assert np.abs(values.mean(axis=0)).max() < 1e-10
    assert np.abs(values.std(axis=0) - 1).max() < 1e-10


def test_scalers_on_small_columns(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(1, 5)], "x double, c double")
    got = lambda m: sorted(r["x"] for r in scale.fit_scaler(df, ["x", "c"], m).transform(df).collect())
    assert got("standard")[0] == pytest.approx(-1.3416407865)
    assert got("minmax") == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert got("robust") == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert got(None) == [1, 2, 3, 4] and got("other") == [1, 2, 3, 4]
    for method in ("standard", "minmax", "robust"):
        scaler = scale.fit_scaler(df, ["x", "c"], method)
        assert {r["c"] for r in scaler.transform(df).collect()} == {0.0}
        assert sorted(r["x"] for r in scaler.inverse(scaler.transform(df)).collect()) == pytest.approx([1, 2, 3, 4])
        assert scale.Scaler.from_frame(scaler.to_frame(spark)) == scaler


@pytest.mark.parametrize("buffer_rows", [10_000_000, 50])
def test_quantiles_agree_with_numpy_on_both_ways(spark, buffer_rows):
    rng = np.random.default_rng(3)
    # A third of all rows are one value.
    values = np.concatenate([rng.normal(0, 10, 4000), np.full(2000, 1.5)])
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "x double, y int").repartition(5)
    probabilities = [0.0, 0.01, 0.25, 0.4, 0.5, 0.61803, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x", "y"], probabilities, buffer_rows)
    assert got["x"] == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-12)
    assert got["y"] == pytest.approx(list(np.quantile(np.arange(6000) % 3, probabilities)), abs=1e-12)


def test_outliers_are_removed_column_by_column(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(0, 1, (500, 2))
    data[::17, 0] += 9
    data[::13, 1] -= 7
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id long, x double, y double")
    kept = np.arange(500)
    for j in range(2):
        q1, q3 = np.quantile(data[kept, j], [0.25, 0.75])
        inside = (data[kept, j] >= q1 - 1.5 * (q3 - q1)) & (data[kept, j] <= q3 + 1.5 * (q3 - q1))
        kept = kept[inside]
    got = prepare.remove_outliers(df, "iqr", columns=["x", "y"])
    assert column(got, "id") == list(kept)
    report = prepare.outlier_report(df, got).first()
    assert report["removed"] == 500 - len(kept) and report["removed_percent"] == pytest.approx((500 - len(kept)) / 5)
    kept = np.arange(500)
    for j in range(2):
        kept = kept[np.abs((data[kept, j] - data[kept, j].mean()) / data[kept, j].std()) < 2]
    assert column(prepare.remove_outliers(df, "zscore", 2.0, ["x", "y"]), "id") == list(kept)


def test_outlier_rows_with_gaps(gappy):
    assert column(prepare.remove_outliers(gappy, "zscore", 3.0, ["x"]), "id") == [1, 2, 5, 6]
    assert column(prepare.remove_outliers(gappy, "iqr", columns=["x"], keep_null=True), "id") == [1, 2, 3, 4, 5, 6]
    assert column(prepare.remove_outliers(gappy, "iqr", columns=["x"], joint=True), "id") == [1, 2, 5, 6]


def test_range_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 1.0).alias("x")).write.parquet(str(tmp_path / "t"))
    kept = prepare.remove_outliers(spark.read.parquet(str(tmp_path / "t")), "iqr", 0.1)
    assert "GreaterThanOrEqual(x" in kept._jdf.queryExecution().executedPlan().toString()


def test_dense_index_is_whole_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = with_dense_index(df, ["v"]).orderBy("v").collect()
    assert [r["row_id"] for r in rows] == list(range(1000))


def test_pca_keeps_variance_and_signs(golden_ff):
    x = matrix_of(golden_ff)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    model = reduce.fit_pca(golden_ff, 2)
    assert model.explained_variance_ratio == pytest.approx(values[::-1][:2] / values.sum())
    for row in model.components:
        assert row[np.abs(row).argmax()] > 0
    top = vectors[:, ::-1][:, :2]
    projected = matrix_of(model.project(golden_ff))
    assert np.abs(projected) == pytest.approx(np.abs((x - x.mean(axis=0)) @ top), abs=1e-9)
    restored = projected @ model.components + model.mean
    errors = [r["error"] for r in model.reconstruction_error(golden_ff).orderBy("row_id").collect()]
    assert errors == pytest.approx(((x - restored) ** 2).mean(axis=1))
    assert matrix_of(model.back_project(model.project(golden_ff))) == pytest.approx(restored)


def test_pca_only_when_wide(golden_ff):
    same, model = reduce.reduce_if_wide(golden_ff, 5)
    assert model is None and same is golden_ff
    assert matrix_of(reduce.reduce_if_wide(golden_ff, 3)[0]).shape == (300, 3)


def test_l2_and_zero_rows(spark):
    ff = prepare.normalize_rows(frame_of(spark, [[3, 4], [0, 0]]))
    assert matrix_of(ff).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_views_do_not_depend_on_partitioning(golden_ff):
    one = prepare.augment(golden_ff.repartition(1)).orderBy("row_id").collect()
    many = prepare.augment(golden_ff.repartition(8)).orderBy("row_id").collect()
    assert one == many
    dropped = np.mean([[v == 0.0 for v in r["view_dropout"]] for r in one])
    noise = np.std([np.subtract(r["view_noise"], r["features"]) for r in one])
    assert 0.07 < dropped < 0.13 and 0.09 < noise < 0.11


def test_describe_and_preview(spark):
    df = spark.createDataFrame([(i, "a long text cell" if i else "short") for i in range(4)], "id long, s string")
    row = profile.describe(df).first()
    assert (row["count"], row["mean"], row["q25"], row["std"]) == (4, 1.5, 0.75, pytest.approx(np.std(range(4), ddof=1)))
    assert [r["s"] for r in profile.preview(df, ["id"], rows=2).collect()] == ["short", "a long tex..."]
    assert {r["data_type"]: r["n_columns"] for r in profile.type_histogram(df).collect()} == {"bigint": 1, "string": 1}


def test_quantiles_of_two_heavy_values_with_a_distinct_middle(spark):
    rows = [(0.0,)] * 3000 + [(1.0,)] * 3000 + [(i / 100,) for i in range(1, 100)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    values = np.array([r[0] for r in rows if r[0] is not None])
    probabilities = [0.0, 0.1, 0.4921, 0.5, 0.5005, 0.51, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probabilities, 10)["x"]
    assert got == pytest.approx(np.quantile(values, probabilities))


def test_quantiles_of_many_columns_share_the_buffer(spark):
    columns = [f"c{i}" for i in range(60)]
    df = spark.range(50).select(*[((F.col("id") * (i + 3)) % 50).cast("double").alias(c) for i, c in enumerate(columns)])
    got = exact_quantiles(df, columns, [0.5], 120)
    want = df.toPandas().quantile(0.5)
    assert all(got[c][0] == pytest.approx(want[c]) for c in columns)


def test_columns_without_values_are_refused(spark):
    from starling.operators.scale import fit_scaler
    from starling.plans.run import run

    df = spark.createDataFrame([(i, float(i), None) for i in range(20)], "id long, x double, empty double")
    for method in ("standard", "robust", "minmax"):
        with pytest.raises(ValueError, match="empty"):
            fit_scaler(df, ["x", "empty"], method)
    for scale in ("standard", "robust", "minmax", None):
        with pytest.raises(ValueError, match="empty"):
            run(df, "kmeans", id_col="id", scale=scale, n_clusters=2)


def test_components_without_a_covariance_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 90)) * np.linspace(3, 0.1, 90) + 7.0
    ff = frame_of(spark, x).repartition(5)
    # 4 + 5 directions: their three blocks do not span the 90 columns, so several rounds are needed.
    model, plain = reduce.fit_pca_range(ff, 4, oversample=5), reduce.fit_pca(ff, 4)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.abs(np.abs(model.components @ vectors[:, ::-1][:, :4]) - np.eye(4)).max() < 1e-6
    assert np.allclose(model.components, plain.components, atol=1e-6)
    assert np.allclose(model.explained_variance_ratio, values[::-1][:4] / values.sum(), atol=1e-9)
    few = reduce.fit_pca_range(ff, 90)
    assert np.allclose(few.components @ few.components.T, np.eye(90), atol=1e-8)


def test_components_of_fewer_rows_than_directions(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(6, 80))
    x[3] = x[2]
    ff = frame_of(spark, x)
    model = reduce.fit_pca_range(ff, 3, oversample=4)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.abs(np.abs(model.components @ vectors[:, ::-1][:, :3]) - np.eye(3)).max() < 1e-6
    same = reduce.fit_pca_range(frame_of(spark, np.ones((4, 80))), 2, oversample=2)
    assert np.all(same.explained_variance_ratio == 0)
    with pytest.raises(ValueError, match="two rows"):
        reduce.fit_pca_range(frame_of(spark, x[:1]), 2)
    with pytest.raises(RuntimeError, match="did not settle"):
        reduce.fit_pca_range(frame_of(spark, np.random.default_rng(7).normal(size=(200, 80))), 2, oversample=1, max_rounds=1)
    monkeypatch.setattr(reduce, "DENSE_COLUMNS", 10)
    reduced, chosen = reduce.reduce_if_wide(ff, 3)
    assert matrix_of(reduced).shape == (6, 3) and np.allclose(chosen.components, model.components, atol=1e-6)
