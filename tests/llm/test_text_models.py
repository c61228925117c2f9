"""Toxicity and quality classifiers, and their parts."""

import random
import zlib

import numpy as np

from starling.llm import labels as L
from starling.llm import quality, toxicity
from starling.llm.boosting import BoostedTrees, Isotonic

PLAIN = "the of and road tree house river light stone green walk over under field".split()


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    docs, marks = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zorgvil", "zorgmat", "idiot", "moron"]))
        good = i % 5 != 0
        if not good:
            words = [rng.choice([w + "%%%" for w in words]) for _ in words] if i % 2 else [words[0]] * 40
        docs.append((i, " ".join(words), "x", 1))
        marks.append((i, int(good), int(toxic and good)))
    return docs, marks


def frames(spark, docs, marks):
    return spark.createDataFrame(docs, "doc_id long, text string, score string, label int"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(trees=40).fit(x[:2000], y[:2000], np.ones(2000))
    assert ((model.scores(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    flat = BoostedTrees(trees=3).fit(np.zeros((10, 2)), np.ones(10), np.ones(10))
    assert (flat.scores(np.zeros((2, 2))) > 5).all()


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    s, y, w = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float), rng.random(60) + 0.1
    fit = Isotonic().fit(s, y, w)
    points = np.unique(s)
    means = np.array([np.average(y[s == p], weights=w[s == p]) for p in points])
    mass = np.array([w[s == p].sum() for p in points])
    best = [max(min(np.average(means[a : b + 1], weights=mass[a : b + 1]) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    assert np.allclose(fit(points), best)
    assert (np.diff(fit(np.linspace(-5, 20, 200))) >= 0).all()


def test_held_out_rule_and_sample(spark):
    docs, marks = corpus()
    d, m = frames(spark, docs, [*marks, (None, 1, 1), (3, None, None), (7, 1, 1)])
    sample, weights = L.labelled_sample(d, m, "toxic", 30)
    rows = sample.collect()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i, in d.where(L.held_out(d.doc_id)).select("doc_id").collect())
    kept = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5}
    assert sum(r.label == 1 for r in rows) == 30 and sum(r.label == 0 for r in rows) == 30
    assert {r.text for r in rows} <= {t for i, t, *_ in docs if i in kept}
    assert weights[0] > 1


def test_toxicity_finds_insults_and_learned_words(spark):
    docs, marks = corpus()
    extra = [(900, None, "x", 1), (901, "", "x", 1), (None, "you idiot", "x", 1), (902, "road " * 30000 + "moron", "x", 1), (902, "road " * 30000 + "moron", "x", 1)]
    d, m = frames(spark, docs + extra, marks)
    got = toxicity.scored(d, m).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.doc_id in (900, 901)} == {0} and len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    assert not next(r for r in got if r.doc_id is None).held_out
    assert len({r.score for r in got if r.doc_id == 902}) == 1


def test_features_measure_what_they_name():
    f = toxicity.features("YOU are an id1ot, you i.d.i.o.t! Nice sooo day", {"day": 2.0})
    assert f[0] == np.log1p(len("you are an id ot you i d i o t nice sooo day".split()))
    assert f[3] == np.log1p(1) and f[5] == 2.0 and f[17] == 2.0 and f[18] > 0 and f[8] == 1 / 8
    assert len(toxicity.features(None, {})) == len(f) and not any(toxicity.features("", {}))


def test_classifiers_without_labels_score_zero(spark):
    d, m = frames(spark, corpus()[0][:10], [])
    assert {r.score for r in toxicity.scored(d, m).collect()} == {0.0}
    assert {r.score for r in quality.scored(d, m).collect()} == {0.0}
    e, m = frames(spark, [], corpus()[1])
    assert toxicity.scored(e, m).count() == 0 and quality.scored(e, m).count() == 0


def test_quality_learns_symbols_and_repeats(spark):
    docs, marks = corpus(1, 800)
    extra = [(9000, None, "x", 1), (9001, "", "x", 1), (None, "a", "x", 1), (9002, "stone%%% " * 20000, "x", 1)]
    d, m = frames(spark, docs + extra, marks)
    got = quality.scored(d, m).collect()
    truth = {i: q for i, q, _ in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(docs) + 4 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert next(r for r in got if r.doc_id == 9002).predicted == 0


def test_network_pools_over_the_whole_text_like_brute_force():
    net = quality.ByteNetwork()
    net._start()
    tables = net.tables()
    for text in ("", "a", "héllo wörld " * 7, "abc " * 3000 + "the end", "x" * 40000):
        own = quality.symbols(text)
        places = max(1, -(-len(own) // quality.STRIDE))
        padded = np.concatenate([own, np.full(quality.WIDTH + 2, quality.PAD)])
        out = np.array([sum(tables[o][padded[p * quality.STRIDE + o]] for o in range(quality.WIDTH)) for p in range(places)])
        tops = np.array([np.maximum(out[a : a + quality.CHUNK].max(axis=0), 0) for a in range(0, places, quality.CHUNK)])
        assert np.allclose(net.pool(text, tables), np.concatenate([tops.max(axis=0), tops.mean(axis=0)]), atol=1e-5)


def test_symbols_mark_repeats():
    raw = ("abcd" * 9 + "the quick brown fox jumps over it " + "Aningen, " * 6).encode() * 700
    got = quality.symbols(raw.decode())
    for i in random.Random(2).sample(range(len(raw)), 3000):
        gram = raw[i : i + 8]
        want = len(gram) == 8 and any(i >= p and raw[i - p : i - p + 8] == gram for p in range(3, 25))
        assert got[i] == raw[i] + 256 * want


def test_gradients_match_differences():
    net = quality.ByteNetwork()
    net._start()
    net.p["b"] += 0.3
    streams = [quality.symbols(t) for t in ("hello there", "some other text " * 60, "")]
    y, w = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        tables = net.tables()
        p = net._head(np.stack([net.pool(t, tables) for t in ("hello there", "some other text " * 60, "")]))[1]
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grads = net._gradients(streams, y, w)
    for name in ("w", "b", "w1", "b1", "w2", "b2"):
        flat = net.p[name].reshape(-1)
        k = int(np.abs(grads[name]).argmax())
        old, step = flat[k], 1e-2
        flat[k] = old + step
        up = loss()
        flat[k] = old - step
        down = loss()
        flat[k] = old
        assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[k]) < 0.03 * max(0.05, abs(grads[name].reshape(-1)[k])), name


def test_quality_learns_without_the_longest_texts(spark, monkeypatch):
    rows = [(i, ("good words here " if i % 2 else "#### $$ %% ") * 4, "x") for i in range(1, 80)]
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in rows] + [(500, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(500, "x " * 400_000, "x")], "doc_id long, text string, label string")
    monkeypatch.setattr(quality, "LEARN_BYTES", 1000)
    seen, inner = [], quality.ByteNetwork.fit
    monkeypatch.setattr(quality.ByteNetwork, "fit", lambda self, texts, *rest: (seen.extend(map(len, texts)), inner(self, texts, *rest))[1])
    scores = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert max(seen) <= 1000 and len(scores) == 80 and 0 <= scores[500] <= 1
