import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions import blocks
from starling.operators import evaluate, kmeans, report
from tests.conftest import COLUMNS, frame_of
from tests.test_clustering import KNOWN_CENTERS


@pytest.fixture(scope="module")
def known(spark, golden_ff):
    frame = kmeans.assign(golden_ff, kmeans.centers_frame(spark, KNOWN_CENTERS)).drop("distance").persist()
    frame.count()
    return frame


def test_known_scores(known):
    m = evaluate.calculate_metrics(known)
    assert m["silhouette_score"] == pytest.approx(0.45340358311786805, abs=1e-12)
    assert m["calinski_harabasz_score"] == pytest.approx(364.6070990184131)
    assert m["davies_bouldin_score"] == pytest.approx(0.8768418382)
    assert (m["n_samples"], m["n_clusters"], m["n_noise"]) == (300, 3, 0)
    assert evaluate.silhouette(known, "squared") == pytest.approx(0.6436852043)


def test_scores_do_not_depend_on_partitions_names_or_blocks(known, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    renamed = known.withColumn("cluster", 7 - F.col("cluster"))
    for frame in (known.repartition(1), renamed.repartition(8)):
        assert evaluate.silhouette(frame) == pytest.approx(0.45340358311786805, abs=1e-12)
        assert evaluate.calinski_harabasz(frame) == pytest.approx(364.6070990184131)
        assert evaluate.davies_bouldin(frame) == pytest.approx(0.8768418382)


def test_sampled_silhouette_of_all_rows_is_exact(known):
    assert evaluate.silhouette(known, "sampled", sample_rows=300) == pytest.approx(0.45340358311786805)
    assert evaluate.silhouette(known, "sampled", sample_rows=100) == pytest.approx(0.4534, abs=0.06)


def test_silhouette_with_copies_and_singletons(spark):
    ff = frame_of(spark, [[0.0], [0.0], [0.0], [1.0], [5.0], [5.5], [9.0]])
    labels = [0, 0, 1, 1, 2, 2, 3]
    frame = ff.join(spark.createDataFrame(list(enumerate(labels)), "row_id long, cluster int"), "row_id")
    x, y = np.array([0, 0, 0, 1, 5, 5.5, 9.0]), np.array(labels)
    expected = []
    for i in range(7):
        gap = np.abs(x - x[i])
        own = (y == y[i]).sum()
        a = gap[y == y[i]].sum() / max(own - 1, 1)
        b = min(gap[y == c].mean() for c in set(labels) - {labels[i]})
        expected.append(0.0 if own == 1 else (b - a) / max(a, b))
    rows = evaluate.silhouette_rows(frame).orderBy("row_id").collect()
    assert [r["silhouette"] for r in rows] == pytest.approx(expected)
    assert evaluate.silhouette(frame) == pytest.approx(np.mean(expected))


def test_noise_policies_and_undefined_scores(spark, known):
    noisy = known.withColumn("cluster", F.when(F.col("row_id") % 10 == 0, -1).otherwise(F.col("cluster")))
    drop = evaluate.calculate_metrics(noisy, "drop")
    assert drop["silhouette_score"] == pytest.approx(evaluate.silhouette(noisy.where("cluster <> -1")))
    assert evaluate.calculate_metrics(noisy, "as_cluster")["silhouette_score"] == pytest.approx(evaluate.silhouette(noisy))
    assert evaluate.calculate_metrics(noisy, "skip")["silhouette_score"] is None
    lone = known.withColumn("cluster", F.lit(0))
    assert evaluate.calculate_metrics(lone)["davies_bouldin_score"] is None
    assert evaluate.calculate_metrics(lone, compat=True)["davies_bouldin_score"] == float("inf")
    with pytest.raises(ValueError):
        evaluate.calculate_metrics(lone, "ignore")


def test_agreement(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 0)]
    df = spark.createDataFrame(rows, "t int, p int")
    # By hand: pairs together in both 1 + 3, by t 3 + 3, by p 3 + 6, of 21 pairs.
    expected = 6 * 9 / 21
    assert evaluate.adjusted_rand(df, "t", "p") == pytest.approx((4 - expected) / (7.5 - expected))
    assert evaluate.adjusted_rand(df, "t", "t") == 1.0
    assert evaluate.normalized_mutual_info(df, "t", "t") == pytest.approx(1.0)
    lone = df.withColumn("one", F.lit(1))
    assert evaluate.normalized_mutual_info(lone, "one", "one") == 1.0
    assert evaluate.adjusted_rand(lone, "one", "one") == 1.0
    assert evaluate.normalized_mutual_info(lone, "t", "one") == pytest.approx(0.0)


def test_contrastive_loss_against_numpy(spark):
    rng = np.random.default_rng(1)
    one, two = rng.normal(size=(10, 4)), rng.normal(size=(10, 4))
    views = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(one, two))], "row_id long, z1 array<double>, z2 array<double>")
    got = {r["batch_id"]: r["loss"] for r in evaluate.nt_xent(views, 0.5, batch_rows=6).collect()}
    for b, rows in enumerate((slice(0, 6), slice(6, 10))):
        z = np.vstack([one[rows], two[rows]])
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        n = len(z) // 2
        sim = z @ z.T / 0.5
        losses = [np.log(np.exp(np.delete(sim[i], i)).sum()) - sim[i, (i + n) % (2 * n)] for i in range(2 * n)]
        assert got[b] == pytest.approx(np.mean(losses))
    with pytest.raises(ValueError):
        evaluate.nt_xent(views, batch_rows=10**9)


def test_report_and_sizes(known):
    noisy = known.withColumn("cluster", F.when(F.col("row_id") < 30, -1).otherwise(F.col("cluster")))
    names = {r["name"]: r["size"] for r in report.size_distribution(noisy).collect()}
    assert names["Noise"] == 30 and sum(names.values()) == 300
    rows = report.cluster_report(noisy).collect()
    assert {r["name"] for r in rows} == {"noise", "cluster_0", "cluster_1", "cluster_2"}
    assert sum(r["percent"] for r in rows) == pytest.approx(100)
    heat = report.centroid_heatmap(noisy, COLUMNS, top=2)
    assert {r["name"] for r in heat.collect()} == {"Cluster 0", "Cluster 1", "Cluster 2"}
    assert heat.select("feature").distinct().count() == 2
    assert evaluate.label_counts(noisy).first()["noise_ratio"] == pytest.approx(0.1)
    best = report.top_importance(report.feature_importance(known, COLUMNS), 1).first()
    assert best["feature"] != "feature_5"
    summary = report.report_summary(noisy, "x", evaluate.calculate_metrics(noisy))
    assert summary["features"] == 5 and summary["noise_points"] == 30
    assert report.scatter_frame(noisy, fraction=0.5).count() < 300


def test_elbow_scores(golden_ff):
    rows = evaluate.elbow_scores(golden_ff, [2, 3], n_init=3).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3] and rows[0]["inertia"] > rows[1]["inertia"]
    assert rows[1]["silhouette"] == pytest.approx(0.4533, abs=3e-4)


def test_labellings_share_distances_and_one_sum_leaves_a_block(spark, golden_ff, monkeypatch):
    def refused(*_):
        raise AssertionError("pairs of small blocks are shuffled")

    monkeypatch.setattr(evaluate, "large_blocks", lambda rows, width: 40)
    monkeypatch.setattr(evaluate, "TILE", (16, 32))
    twice = golden_ff.unionByName(golden_ff.withColumn("row_id", F.col("row_id") + 1000).where("row_id < 1050"))
    fits = {k: points for k, (_, points, _) in evaluate.fit_each_k(twice, [2, 3, 5], n_init=2).items()}
    expected = [evaluate.silhouette(evaluate.assign(twice, evaluate.centers_frame(spark, points))) for points in fits.values()]
    monkeypatch.setattr(evaluate, "block_pairs", refused)
    rows = evaluate.elbow_scores(twice, [2, 3, 5], n_init=2).orderBy("k").collect()
    assert [r["silhouette"] for r in rows] == pytest.approx(expected, abs=1e-12)
