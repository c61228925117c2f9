import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starling.functions import blocks
from starling.operators import components, condense, dbscan, divisive, evaluate, hdbscan, hierarchical, kmeans, linkage, soft, spectral
from starling.plans import queries
from tests.conftest import frame_of, labels_of, matrix_of
from tests.plain_condense import plain_condense

# Centres of a known k = 3 run in scaled space.
KNOWN_CENTERS = [
    (-0.64300, 0.57978, -0.05075, -0.40225, 0.20118),
    (-0.67784, -1.33245, -1.16839, -0.92022, -0.07759),
    (1.31980, 0.69529, 1.18560, 1.30694, -0.13195),
]
KNOWN_NOISE = [9, 89, 104, 155, 187, 287, 291]


def clumps(seed=1, d=2):
    """Dense clumps, scatter, and copies of one point, shuffled."""
    rng = np.random.RandomState(seed)
    shift = np.zeros(d)
    shift[0] = 0.5
    parts = [rng.normal(0, 0.05, (120, d)), rng.normal(shift, 0.05, (120, d)), rng.uniform(-1, 1, (120, d)), np.zeros((100, d))]
    data = np.vstack(parts)
    return data[rng.permutation(len(data))]


def brute_dbscan(x, eps, min_samples):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_samples
    label = -np.ones(len(x), int)
    count = 0
    for i in range(len(x)):
        if core[i] and label[i] == -1:
            label[i] = count
            stack = [i]
            while stack:
                u = stack.pop()
                for v in np.where(near[u] & core)[0]:
                    if label[v] == -1:
                        label[v] = count
                        stack.append(v)
            count += 1
    for i in np.where(~core)[0]:
        if (near[i] & core).any():
            label[i] = label[near[i] & core].min()
    return label


def same_partition(a, b):
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len(set(a.tolist())) == len(set(b.tolist()))


# ------------------------------------------------------------------ k-means


def test_known_centres_are_a_fixed_point(spark, golden_ff):
    labelled, centers, _ = kmeans.kmeans_lloyd(golden_ff, kmeans.centers_frame(spark, KNOWN_CENTERS), 3)
    assert np.bincount(labels_of(labelled)).tolist() == [103, 97, 100]
    assert kmeans.inertia(labelled).first()[0] == pytest.approx(434.1198950982, abs=1e-8)
    found = np.array([r["center"] for r in centers.orderBy("cluster").collect()])
    assert np.abs(found - np.array(KNOWN_CENTERS)).max() < 1e-5


def test_best_of_ten_reaches_the_known_costs(golden_ff):
    three = kmeans.kmeans(golden_ff, 3)
    assert three.inertia <= 434.1198950982 * (1 + 1e-3) and three.n_clusters == 3
    assert sorted(np.bincount(labels_of(three.labels))) in ([97, 100, 103], [97, 101, 102])
    assert kmeans.kmeans(golden_ff, 4).inertia <= 374.35


def test_few_distinct_points_give_fewer_centres(spark):
    ff = frame_of(spark, [[0.0], [0.0], [1.0], [1.0]])
    fit = kmeans.kmeans(ff, 5, n_init=2)
    assert fit.n_clusters == 2 and fit.inertia == 0.0


def test_lloyd_never_gets_worse_and_keeps_empty_centres(spark, golden_ff):
    start = kmeans.centers_frame(spark, [[0.0] * 5, [0.1] * 5, [99.0] * 5])
    costs = []
    for rounds in (1, 2, 4):
        labelled, centers, _ = kmeans.kmeans_lloyd(golden_ff, start, rounds)
        costs.append(labelled.agg(F.sum(F.col("distance") ** 2)).first()[0])
    assert costs == sorted(costs, reverse=True)
    assert centers.where("cluster = 2").first()["center"] == [99.0] * 5


def test_assignment_ways_agree(spark, golden_ff, monkeypatch):
    centers = kmeans.centers_frame(spark, KNOWN_CENTERS)
    plain = labels_of(kmeans.assign(golden_ff, centers))
    monkeypatch.setattr(kmeans, "UNROLL_TERMS", 0)
    assert (labels_of(kmeans.assign(golden_ff, centers)) == plain).all()
    monkeypatch.setattr(kmeans, "SHIPPED_VALUES", 1)
    assert (labels_of(kmeans.assign(golden_ff, centers)) == plain).all()


def test_assignment_ties_go_to_the_lowest_label(spark):
    centers = kmeans.centers_frame(spark, [[1.0], [-1.0]])
    assert labels_of(kmeans.assign(frame_of(spark, [[0.0]]), centers)).tolist() == [0]


def test_many_tasks_and_split_passes_give_the_same_sums(golden_ff, monkeypatch):
    rng = np.random.default_rng(0)
    starts = {i: rng.normal(size=(3, 5)) for i in range(4)}
    middle = np.zeros(5)
    data = golden_ff.select("features").repartition(8)
    one = kmeans._round(data.coalesce(1), 1, starts, middle)
    monkeypatch.setattr(kmeans, "SHIPPED_VALUES", 30)
    many = kmeans._round(data, 8, starts, middle)
    x = matrix_of(golden_ff)
    for i, start in starts.items():
        near = ((x[:, None] - start[None]) ** 2).sum(-1)
        for sums, counts, cost in (one[i], many[i]):
            assert counts.tolist() == np.bincount(near.argmin(1), minlength=3).tolist()
            assert sums == pytest.approx(np.array([x[near.argmin(1) == c].sum(0) for c in range(3)]))
            assert cost == pytest.approx(near.min(1).sum())


def test_knee(spark):
    costs = spark.createDataFrame([(2, 100.0), (3, 70.0), (4, 40.0), (5, 38.0), (6, 37.0)], "k int, inertia double")
    assert kmeans.knee(costs).first()["k"] == 4
    assert kmeans.knee(costs, compat=True).first()["k"] == 3
    assert kmeans.knee(costs.where("k < 4")).first()["k"] == 2


def test_elbow_stays_in_range(golden_ff):
    k, costs = kmeans.elbow(golden_ff, max_k=5, n_init=2)
    values = [r["inertia"] for r in costs.orderBy("k").collect()]
    assert 2 <= k <= 5 and len(values) == 4 and values == sorted(values, reverse=True)


# ------------------------------------------------------------------ DBSCAN


def test_dbscan_known_run(golden_ff):
    fit = dbscan.dbscan(golden_ff, 0.8, 5)
    assert (fit.n_clusters, fit.n_noise) == (1, 7)
    noise = fit.labels.where("cluster = -1").orderBy("row_id").collect()
    assert [r["row_id"] for r in noise] == KNOWN_NOISE
    scores = evaluate.calculate_metrics(fit.labels, noise="as_cluster")
    assert scores["silhouette_score"] == pytest.approx(0.2227772865774005, abs=1e-12)
    assert scores["calinski_harabasz_score"] == pytest.approx(1.1423442521338547)
    assert scores["davies_bouldin_score"] == pytest.approx(5.6848644850)
    assert (scores["n_clusters"], scores["n_labels"]) == (1, 2)


@pytest.mark.parametrize("d, eps, min_samples, crowd", [(1, 0.02, 4, 50_000), (2, 0.06, 5, 4), (3, 0.15, 6, 50_000), (5, 0.3, 5, 20)])
def test_dbscan_equals_brute_force(spark, monkeypatch, d, eps, min_samples, crowd):
    monkeypatch.setattr(dbscan, "CROWD", crowd)
    x = clumps(d=d)
    got = labels_of(dbscan.dbscan_labels(frame_of(spark, x), eps, min_samples))
    assert (got == brute_dbscan(x, eps, min_samples)).all()


def test_dbscan_splits_crowded_cell_pairs(spark, monkeypatch):
    """Two crowds in touching cells, closer or farther than eps, never pair up whole."""
    rng = np.random.RandomState(2)
    for gap in (0.45, 0.62):
        x = np.vstack([rng.uniform(0, 0.3, (150, 2)), rng.uniform(0, 0.3, (150, 2)) + [0.3 + gap, 0]])
        expected = brute_dbscan(x, 0.5, 5)
        for limit in (1, 400):
            monkeypatch.setattr(dbscan, "POINT_PAIRS", limit)
            assert (labels_of(dbscan.dbscan_labels(frame_of(spark, x), 0.5, 5)) == expected).all()


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    rng = np.random.RandomState(4)
    links = [(i, i + 1) for i in range(60) if i % 13] + [(int(a), int(b)) for a, b in rng.randint(100, 200, (60, 2))]
    edges = spark.createDataFrame(links, "a long, b long")
    nodes = spark.range(200).withColumnRenamed("id", "node")
    root = list(range(200))
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    for limit in (100_000, 0):
        monkeypatch.setattr(components, "SMALL_GRAPH_EDGES", limit)
        got = {r["node"]: r["component"] for r in components.connected_components(edges, nodes).collect()}
        assert got == dict(enumerate(root))


def test_dbscan_meets_by_pivots_where_coordinates_do_not_separate(spark):
    # Corners of a cube in 40 dimensions: each coordinate is 0 or 1 for half the points, pivots tell them apart.
    rng = np.random.RandomState(2)
    corners = rng.randint(0, 2, (60, 40)).astype(float)
    x = (corners[:, None] + rng.uniform(-0.02, 0.02, (60, 5, 40))).reshape(-1, 40)
    ff = frame_of(spark, x)
    labels = labels_of(dbscan.dbscan_labels(ff, 0.5, 3))
    assert (labels == np.repeat(np.arange(60), 5)).all()
    row = dbscan.candidates(ff, 0.5).first()
    assert row["near"] <= row["met"] < 0.5 * row["cells"] ** 2


def test_dbscan_where_nothing_separates(spark):
    x = np.random.RandomState(3).normal(size=(120, 30))
    x /= np.linalg.norm(x, axis=1)[:, None]
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels = labels_of(dbscan.dbscan_labels(frame_of(spark, x), 1.05, 3))
    core = (gap <= 1.05).sum(1) >= 3
    assert ((labels >= 0) == ((gap <= 1.05) & core[None]).any(1)).all() and 0 < core.sum() < 120


# ------------------------------------------------------------------ hierarchical


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        mean = np.array([x[g].mean(0) for g in groups])
        n = np.array([len(g) for g in groups], float)
        cost = ((mean[:, None] - mean[None]) ** 2).sum(-1) * (n[:, None] * n[None] / (n[:, None] + n[None]))
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(cost.argmin()), len(groups)))
        groups[i] += groups.pop(j)
    label = np.empty(len(x), int)
    for c, members in enumerate(sorted(groups, key=min)):
        label[members] = c
    return label


def test_ward_equals_brute_force_locally_and_in_rounds(spark, golden_ff, monkeypatch):
    expected = brute_ward(matrix_of(golden_ff), 4)
    assert (labels_of(hierarchical.hierarchical(golden_ff, 4).labels) == expected).all()
    monkeypatch.setattr(hierarchical, "LOCAL_CLUSTERS", 120)
    assert (labels_of(hierarchical.hierarchical(golden_ff, 4).labels) == expected).all()


def test_ward_with_copies(spark):
    x = np.vstack([clumps()[:80], np.zeros((40, 2))])
    assert (labels_of(hierarchical.hierarchical(frame_of(spark, x), 3).labels) == brute_ward(x, 3)).all()


def test_other_linkages(spark):
    ff = frame_of(spark, [[0.0], [1.0], [2.1], [3.3], [10.0]])
    assert labels_of(hierarchical.hierarchical(ff, 2, "single").labels).tolist() == [0, 0, 0, 0, 1]
    assert labels_of(hierarchical.hierarchical(ff, 3, "complete").labels).tolist() == [0, 0, 1, 1, 2]
    assert labels_of(hierarchical.hierarchical(ff, 3, "average").labels).tolist() == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        hierarchical.hierarchical(ff, 2, "centroid")


def brute_linkage(x, k, linkage):
    """Merges the first pair in the order of (distance, smaller id, larger id), with plain sums over pairs."""
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = {}
    for i, row in enumerate(x.tolist()):
        groups.setdefault(tuple(row), []).append(i)
    groups = {g[0]: g for g in groups.values()}
    if linkage == "single":
        first = sorted(groups)
        owner, kept = {i: i for i in first}, []
        for d, a, b in sorted((gap[a, b], a, b) for a in first for b in first if a < b):
            if owner[a] != owner[b]:
                kept.append((a, b))
                owner = {i: owner[a] if o == owner[b] else o for i, o in owner.items()}
        owner = {i: i for i in first}
        for a, b in kept[: len(first) - k]:
            owner = {i: min(owner[a], owner[b]) if o in (owner[a], owner[b]) else o for i, o in owner.items()}
        merged = {}
        for i in first:
            merged.setdefault(owner[i], []).extend(groups[i])
        groups = merged
    while len(groups) > k:
        def far(a, b):
            part = gap[np.ix_(groups[a], groups[b])]
            # Steps of 2^-40 make equal means equal.
            return part.max() if linkage == "complete" else np.floor(part * 2.0**40).sum() / part.size

        _, a, b = min((far(a, b), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
    label = np.empty(len(x), int)
    for c, members in enumerate(sorted(groups.values(), key=min)):
        label[members] = c
    return label


@pytest.mark.parametrize("kind", ["average", "complete", "single"])
def test_linkages_on_grids_fall_alike_at_every_size(spark, kind, monkeypatch):
    rng = np.random.RandomState(5)
    for side, k in ((5, 6), (12, 4)):
        x = rng.randint(0, side, (63, 2)).astype(float)
        expected = brute_linkage(x, k, kind)
        ff = frame_of(spark, x)
        assert (labels_of(hierarchical.hierarchical(ff, k, kind).labels) == expected).all()
        with monkeypatch.context() as bound:
            bound.setattr(linkage, "LOCAL_CLUSTERS", 20 if side > 5 else 5)
            bound.setattr(blocks, "BLOCK_ROWS", 24)
            bound.setattr(blocks.block_pairs, "__defaults__", (24,))
            bound.setattr(hdbscan, "FOREST_EDGES", 20)
            assert (labels_of(hierarchical.hierarchical(ff, k, kind).labels) == expected).all()


def test_average_linkage_beyond_one_place(golden_ff, monkeypatch):
    expected = labels_of(hierarchical.hierarchical(golden_ff, 5, "average").labels)
    monkeypatch.setattr(linkage, "LOCAL_CLUSTERS", 150)
    assert (labels_of(hierarchical.hierarchical(golden_ff, 5, "average").labels) == expected).all()


def plain_split(x):
    """Two-means of a set from a deviation before and behind the mean of the widest dimension."""
    j = np.flatnonzero(x.var(axis=0) >= x.var(axis=0).max() * (1 - 1e-9))[0]
    step = np.eye(x.shape[1])[j] * x[:, j].std()
    centers = np.stack([x.mean(0) - step, x.mean(0) + step])
    while True:
        side = ((x - centers[1]) ** 2).sum(1) < ((x - centers[0]) ** 2).sum(1)
        means = np.stack([x[~side].mean(0), x[side].mean(0)])
        if ((means - centers) ** 2).sum() <= 1e-4 * x.var(axis=0).sum():
            return side
        centers = means


def test_divisive_against_plain_splits(spark, golden_ff):
    x = matrix_of(golden_ff)
    leaves = [np.arange(len(x))]
    while len(leaves) < 6:
        order = sorted(range(len(leaves)), key=lambda i: -len(leaves[i]))[: 6 - len(leaves)]
        sides = {i: plain_split(x[leaves[i]]) for i in order}
        leaves = [part for i, leaf in enumerate(leaves) for part in ((leaf[~sides[i]], leaf[sides[i]]) if i in sides else (leaf,))]
    want = np.empty(len(x), int)
    for c, leaf in enumerate(sorted(leaves, key=min)):
        want[leaf] = c
    fit = divisive.divisive(golden_ff, 6)
    assert (labels_of(fit.labels) == want).all() and fit.n_clusters == 6
    nodes = {r["node"]: r for r in fit.nodes.collect()}
    assert len(nodes) == 11 and nodes[0]["parent"] is None and nodes[0]["rows"] == 300
    for node, row in nodes.items():
        below = [r for r in nodes.values() if r["parent"] == node]
        assert (row["cluster"] is None) == (len(below) == 2) and (not below or sum(r["rows"] for r in below) == row["rows"])
        if not below:
            own = x[want == row["cluster"]]
            assert np.allclose(row["center"], own.mean(0)) and np.isclose(row["cost"], ((own - own.mean(0)) ** 2).sum())


def test_divisive_of_few_points(spark):
    fit = divisive.divisive(frame_of(spark, [[0.1, 2.0]] * 5 + [[7.3, 2.0]] * 2), 5)
    assert labels_of(fit.labels).tolist() == [0] * 5 + [1] * 2 and fit.n_clusters == 2
    assert labels_of(divisive.divisive(frame_of(spark, [[3.0]]), 2).labels).tolist() == [0]
    with pytest.raises(ValueError):
        divisive.divisive(frame_of(spark, [[3.0]]).limit(0), 2)


def test_linkages_of_few_points(spark):
    for kind in ("average", "complete", "single"):
        assert labels_of(hierarchical.hierarchical(frame_of(spark, [[1.0]] * 3), 2, kind).labels).tolist() == [0, 0, 0]
        assert labels_of(hierarchical.hierarchical(frame_of(spark, [[0.0], [1.0]]), 5, kind).labels).tolist() == [0, 1]


def test_summaries_label_every_row(golden_ff):
    for kind in ("ward", "average"):
        fit = hierarchical.hierarchical(golden_ff, 3, kind, summaries=60)
        sizes = np.bincount(labels_of(fit.labels))
        assert sizes.sum() == 300 and len(sizes) == 3 and fit.summaries == 60


# ------------------------------------------------------------------ spectral, HDBSCAN


def rings(spark):
    rng = np.random.RandomState(0)
    angle = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    circle = np.column_stack([np.cos(angle), np.sin(angle)])
    x = np.vstack([circle, 4 * circle]) + rng.normal(0, 0.03, (240, 2))
    return frame_of(spark, x), np.repeat([0, 1], 120)


def test_spectral_separates_rings(spark):
    ff, truth = rings(spark)
    fit = spectral.spectral(ff, 2, gamma=20.0, n_init=3)
    assert fit.exact and same_partition(labels_of(fit.labels), truth)
    part = spectral.spectral(ff, 2, gamma=5.0, landmarks=120, n_init=3)
    assert not part.exact and same_partition(labels_of(part.labels), truth)


def test_spectral_is_exact_beyond_one_place(spark, golden_ff, monkeypatch):
    local = spectral.spectral(golden_ff, 3, gamma=0.5, n_init=3)
    monkeypatch.setattr(spectral, "MAX_LANDMARKS", 100)
    fit = spectral.spectral(golden_ff, 3, gamma=0.5, n_init=3)
    assert fit.exact and fit.landmarks == 300 and same_partition(labels_of(fit.labels), labels_of(local.labels))
    ff, truth = rings(spark)
    assert same_partition(labels_of(spectral.spectral(ff, 2, gamma=20.0, n_init=3).labels), truth)


@pytest.mark.parametrize("name", ["elbow_table", "elbow_scores"])
def test_elbow_queries_try_every_k(spark, name):
    ks = [r["k"] for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").select("k").collect()]
    assert sorted(ks) == list(range(2, 21))


def test_spectral_rbf_takes_all_points(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(queries, "spectral", lambda *a, **b: fits.append(spectral.spectral(*a, **b)) or fits[-1])
    labels = queries.QUERIES["spectral_rbf"](spark, "/root/testdata/sf0.01")
    assert fits[0].exact and fits[0].landmarks > 500 and labels.count() == 2000


def test_exact_coordinates_equal_a_dense_solver(spark):
    rng = np.random.RandomState(3)
    x, n = rng.normal(0, 1, (150, 2)), rng.randint(1, 4, 150)
    points = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, n))], "id long, features array<double>, n long")
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    degree = kernel @ n
    scale = np.sqrt(n / degree)
    _, vectors = np.linalg.eigh(kernel * scale[:, None] * scale[None, :])
    want = vectors[:, ::-1][:, :3] / np.sqrt(n * degree)[:, None]
    place = {tuple(r): i for i, r in enumerate(x.tolist())}
    got = np.zeros((150, 3))
    for r in spectral._exact_coordinates(points, 3, 1.0, 42).collect():
        got[place[tuple(r["features"])]] = r["coordinates"]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-5


def brute_hdbscan(x, size, min_samples):
    """Top-down over the dendrogram, written independently of the operator."""
    n = len(x)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(gap, axis=1)[:, min_samples]
    reach = np.maximum(gap, np.maximum(core[:, None], core[None]))
    trees = {i: ("leaf", [i]) for i in range(n)}
    owner = list(range(n))
    for i, j in sorted(((i, j) for i in range(n) for j in range(i)), key=lambda p: reach[p]):
        a, b = owner[i], owner[j]
        if a != b:
            trees[a] = ("node", trees[a][1] + trees[b][1], reach[i, j], trees[a], trees[b])
            owner = [a if o == b else o for o in owner]
    clusters = []

    def grow(tree, birth):
        me = {"birth": birth, "stability": 0.0, "children": [], "rows": tree[1]}
        clusters.append(me)
        while True:
            if tree[0] == "leaf":
                return me
            level, kids = 1 / tree[2], [tree[3], tree[4]]
            big = [k for k in kids if len(k[1]) >= size]
            if len(big) == 1:
                me["stability"] += (level - birth) * (len(tree[1]) - len(big[0][1]))
                tree = big[0]
                continue
            me["stability"] += (level - birth) * len(tree[1])
            if len(big) == 2:
                me["children"] = [grow(k, level) for k in big]
            return me

    def best(c, root=False):
        below = [best(k) for k in c["children"]]
        total = sum(s for s, _ in below)
        if root or (below and c["stability"] < total):
            return total, [g for _, gs in below for g in gs]
        return c["stability"], [c]

    label = -np.ones(n, int)
    chosen = best(grow(trees[owner[0]], 0.0), root=True)[1]
    for k, c in enumerate(sorted(chosen, key=lambda c: min(c["rows"]))):
        label[c["rows"]] = k
    return label


def test_hdbscan_equals_brute_force(spark):
    rng = np.random.RandomState(7)
    x = np.vstack([rng.normal(m, s, (40, 2)) for m, s in (((0, 0), 0.3), ((3, 0), 0.5), ((0, 4), 0.2))] + [rng.uniform(-3, 6, (20, 2))])
    x = x[rng.permutation(len(x))]
    fit = hdbscan.hdbscan(frame_of(spark, x), 8)
    # Rows of a chosen cluster that fall out before it splits stay its members.
    assert (labels_of(fit.labels) == brute_hdbscan(x, 8, 8)).all()
    assert fit.n_clusters == 3 and all(0 < p <= 1 for p in fit.persistence)


def test_hdbscan_over_many_blocks(spark):
    rng = np.random.RandomState(3)
    x = np.vstack([rng.normal(m, 1, (3500, 2)) for m in ((0, 0), (40, 0))])
    fit = hdbscan.hdbscan(frame_of(spark, x.round(4)), 50)
    labels = labels_of(fit.labels)
    assert fit.n_clusters == 2 and fit.n_noise == (labels == -1).sum() < 100
    assert set(labels[:3500]) - {-1} == {0} and set(labels[3500:]) - {-1} == {1}


def test_forest_is_a_minimum_spanning_forest():
    rng = np.random.RandomState(0)
    a, b, w = rng.randint(0, 30, 200), rng.randint(0, 30, 200), rng.randint(0, 9, 200).astype(float)
    owner, want, size = list(range(30)), 0.0, 0
    for i in np.argsort(w, kind="stable"):
        if owner[a[i]] != owner[b[i]]:
            owner = [owner[a[i]] if o == owner[b[i]] else o for o in owner]
            want, size = want + w[i], size + 1
    got = hdbscan.forest(a, b, w)
    assert len(got) == size and w[got].sum() == want
    assert len(hdbscan.forest(a[:0], b[:0], w[:0])) == 0


def tree_by_hand(x, n, core):
    """Kruskal's tree of distinct points in the order of (gap, a, b)."""
    gap = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.maximum(core[:, None], core[None]))
    owner, kept = list(range(len(x))), []
    for d, a, b in sorted((gap[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):
        if owner[a] != owner[b]:
            kept.append((d, a, b))
            owner = [owner[a] if o == owner[b] else o for o in owner]
    return pd.DataFrame(kept, columns=["gap", "a", "b"])


@pytest.mark.parametrize("side, size, copies", [(9, 4, 0), (6, 3, 3), (30, 5, 0)])
def test_condensed_tree_on_grids_with_ties_and_copies(spark, side, size, copies, monkeypatch):
    rng = np.random.RandomState(side)
    x = np.unique(rng.randint(0, side, (90, 2)), axis=0).astype(float)
    x = x[rng.permutation(len(x))]
    n = np.ones(len(x)) + rng.randint(0, copies + 1, len(x)) * (rng.rand(len(x)) < 0.3)
    core = np.where(n >= size, 0.0, np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 2])
    edges = tree_by_hand(x, n, core)
    points = spark.createDataFrame([(i, float(a), float(c)) for i, (a, c) in enumerate(zip(n, core))], "row_id long, n double, core double")
    want, want_shares = plain_condense(edges, core, n, size)
    for bound in (500_000, 30, 0) if copies else (500_000,):
        monkeypatch.setattr(condense, "LOCAL_EDGES", bound)
        labels, shares, noise = condense.condense(spark.createDataFrame(edges, "gap double, a long, b long"), points, size)
        got = np.array([r["cluster"] for r in labels.orderBy("row_id").collect()])
        assert (got == want).all() and np.allclose(shares, want_shares) and noise == n[want == -1].sum()


def test_condensed_tree_without_meetings(spark):
    points = spark.createDataFrame([(i, 1.0, 1.0) for i in range(4)], "row_id long, n double, core double")
    chain = spark.createDataFrame([(float(i), i, i + 1) for i in range(1, 3)] + [(0.5, 0, 1)], "gap double, a long, b long")
    labels, shares, noise = condense.condense(chain, points, 3)
    assert {r["cluster"] for r in labels.collect()} == {-1} and shares == [] and noise == 4


def test_hdbscan_needs_enough_rows(spark):
    fit = hdbscan.hdbscan(frame_of(spark, [[0.0], [1.0]]), 5)
    assert fit.n_clusters == 0 and fit.n_noise == 2


# ------------------------------------------------------------------ soft assignment


def test_soft_assignment_sums_to_one_and_refines(spark, golden_ff):
    centers = kmeans.centers_frame(spark, KNOWN_CENTERS)
    q = np.array([r["q"] for r in soft.soft_assign(golden_ff, centers, alpha=2.0).orderBy("row_id").collect()])
    x, c = matrix_of(golden_ff), np.array(KNOWN_CENTERS)
    raw = (1 + ((x[:, None] - c[None]) ** 2).sum(-1) / 2.0) ** -1.5
    assert q == pytest.approx(raw / raw.sum(1, keepdims=True))
    p = np.array([r["p"] for r in soft.target_distribution(soft.soft_assign(golden_ff, centers, 2.0)).orderBy("row_id").collect()])
    w = q**2 / q.sum(0)
    assert p == pytest.approx(w / w.sum(1, keepdims=True))


def test_refinement_follows_the_numeric_gradient(spark, golden_ff):
    x, c, alpha, lr = matrix_of(golden_ff), np.array(KNOWN_CENTERS), 1.5, 0.5

    def soft_of(centers):
        raw = (1 + ((x[:, None] - centers[None]) ** 2).sum(-1) / alpha) ** (-(alpha + 1) / 2)
        return raw / raw.sum(1, keepdims=True)

    w = soft_of(c) ** 2 / soft_of(c).sum(0)
    p = w / w.sum(1, keepdims=True)
    loss = lambda centers: (p * np.log(p / soft_of(centers))).sum() / len(x)
    step = np.zeros_like(c)
    for index in np.ndindex(c.shape):
        nudge = np.zeros_like(c)
        nudge[index] = 1e-6
        step[index] = (loss(c + nudge) - loss(c - nudge)) / 2e-6
    fit = soft.dec_refine(golden_ff, kmeans.centers_frame(spark, KNOWN_CENTERS), rounds=1, lr=lr, alpha=alpha)
    got = np.array([r["center"] for r in fit.centers.orderBy("cluster").collect()])
    assert got == pytest.approx(c - lr * step, abs=1e-7)
    assert fit.losses[0] == pytest.approx(loss(c))


def test_deep_embedding_labels_every_row(golden_ff):
    fit = soft.deep_embedding(golden_ff, 3, latent_dim=2, rounds=2, n_init=2)
    assert len(labels_of(fit.labels)) == 300 and len(fit.losses) == 2


def test_refinement_with_many_centre_values(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(0, 1, (400, 24))
    points = x[:30].copy()
    ff = frame_of(spark, x)
    fit = soft.dec_refine(ff, kmeans.centers_frame(spark, points.tolist()), rounds=2, lr=0.5)

    def q_of(c):
        kernel = 1 / (1 + ((x[:, None] - c[None]) ** 2).sum(axis=2))
        return kernel / kernel.sum(axis=1, keepdims=True)

    for loss in fit.losses:
        q = q_of(points)
        p = q**2 / q.sum(axis=0)
        p /= p.sum(axis=1, keepdims=True)
        assert loss == pytest.approx((p * np.log(p / q)).sum(axis=1).mean())
        force = 2 * (q - p) / (1 + ((x[:, None] - points[None]) ** 2).sum(axis=2))
        points = points - 0.5 * (force[:, :, None] * (x[:, None] - points[None])).mean(axis=0)
    rows = fit.labels.orderBy("row_id").collect()
    assert np.allclose([r["q"] for r in rows], q_of(points))
    assert [r["cluster"] for r in rows] == q_of(points).argmax(axis=1).tolist()


def test_starts_cover_rare_distinct_points(spark):
    x = np.vstack([np.zeros((3000, 2)), [[50.0, 0.0]], [[0.0, 50.0]]])
    fit = kmeans.kmeans(frame_of(spark, x), 3, n_init=3)
    assert fit.n_clusters == 3 and fit.inertia == pytest.approx(0.0)
    assert kmeans.kmeans(frame_of(spark, x), 5, n_init=2).n_clusters == 3
