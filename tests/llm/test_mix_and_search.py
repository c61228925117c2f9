"""Decontamination, mixing and top-k search against brute force; the pipeline stage by stage."""

import hashlib
import random
import re
from collections import defaultdict
from math import log

import pytest

import corpus_pipeline
from starling.llm import decontaminate, mixing, simhash, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, items int, print int"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, span=13):
    windows = defaultdict(set)
    for item_id, text in items:
        w = words_of(text)
        n = min(span, len(w))
        if item_id is not None and n:
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item_id))
    out = []
    for doc_id, text, *_ in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def bench(seed, short=True):
    rng = random.Random(seed)
    vocabulary = [f"b{i}" for i in range(30)] + ["Ünï", "x9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(13, 40)))) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (None, "free words here"), (23, "b1 " * 20)]
    if short:
        items += [(30, "alpha"), (31, "alpha, Beta!"), (32, "one two three four five six seven"), (33, "b1 b2 b3")]
    docs = [(-1, None), (-2, ""), (-3, "ALPHA"), (-4, "alpha-beta " * 3 + "y " * 500), (-5, "b1 " * 60), (-6, "one two three four five six seven"), (-7, "x " * 5000 + items[1][1])]
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))]
        if i % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(w))
            body[rng.randrange(len(body) + 1) : 0] = w[a : a + rng.randrange(5, 30)]
        docs.append((i, "; ".join(body).upper() if i % 2 else " ".join(body)))
    docs += [docs[20], docs[20], (docs[21][0], docs[22][1]), (None, docs[10][1])]
    return [(d, t, "l", "s", 1, 2, 3) for d, t in docs], items


@pytest.mark.parametrize("seed,short", [(1, True), (2, False)])
def test_contamination_matches_brute_force(spark, seed, short):
    docs, items = bench(seed, short)
    frame, bad = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame, bad).drop("text_hash").collect()
    want = brute_contamination(docs, items)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    left = decontaminate.clean(frame, bad)
    assert left.columns == frame.columns
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(repr(d) for d, w in zip(docs, want) if not w[-1])


def test_contamination_without_items_or_documents(spark):
    docs, items = bench(3)
    frame, bad = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(frame, bad.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(frame.limit(0), bad).count() == 0


def brute_mix(rows, target=0.95, limit=4.0, budget=None, block_tokens=mixing.BLOCK_TOKENS):
    """(doc_id, source, tokens, epoch, block, rank) drawn, with plain Python loops."""
    md5 = lambda *p: hashlib.md5("|".join("" if x is None else str(x) for x in p).encode()).hexdigest()
    stats = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _, s, *_ in rows]
    totals = defaultdict(int)
    for _, s, n in stats:
        totals[s] += n
    totals = {s: n for s, n in totals.items() if n}
    everything = sum(totals.values())
    budget = everything if budget is None else budget
    p = {s: n / everything for s, n in totals.items()}

    def entropy(a):
        z = sum(x**a for x in p.values())
        return log(z) - a / z * sum(x**a * log(x) for x in p.values())

    def repeats(a):
        return max(x ** (a - 1) for x in p.values()) / sum(x**a for x in p.values()) * budget / everything

    def bisect(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            low, high = ((low + high) / 2, high) if holds((low + high) / 2) else (low, (low + high) / 2)
        return low

    a = 1.0
    if len(p) > 1:
        goal = target * log(len(p))
        by_entropy = 1.0 if entropy(1.0) >= goal else bisect(lambda x: entropy(x) >= goal)
        by_repeats = 1.0 if repeats(1.0) > limit + 1e-12 else 0.0 if repeats(0.0) <= limit else bisect(lambda x: repeats(x) > limit)
        a = round(max(by_entropy, by_repeats), 6)
    out = []
    for s, n in totals.items():
        own = int(round(p[s] ** a / sum(x**a for x in p.values()), 9) * budget)
        blocks = max(1, n // block_tokens)
        of = defaultdict(list)
        for d, s2, k in stats:
            if s2 == s:
                of[int(md5("mix", d)[:8], 16) % blocks].append((md5("mix", d), d, k))
        full, rest = divmod(own, n)
        for epoch in range(1, full + 2):
            done = 0
            for rank, b in enumerate(sorted(of, key=lambda b: md5("mix", epoch, s, b)), start=1):
                room, tokens = rest - done, sum(k for *_, k in of[b])
                done += tokens
                if epoch <= full or (rest and tokens <= room):
                    out += [(d, s, k, epoch, b, rank) for _, d, k in of[b]]
                elif room > 0:
                    upto, groups = 0, defaultdict(int)
                    for m, d, k in of[b]:
                        groups[m, d is None, d or 0, k] += 1
                    for (m, none, d, k), c in sorted(groups.items()):
                        upto += k * c
                        if upto <= room:
                            out += [(None if none else d, s, k, epoch, b, rank)] * c
    return out


@pytest.mark.parametrize("options", [{}, {"target_entropy": 0.999, "max_repeats": 3.0}, {"max_repeats": 1.2}, {"budget_tokens": 40_000}, {"target_entropy": 0.2}, {"budget_tokens": 0}])
def test_mix_matches_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    rng = random.Random(4)
    rows = [(i, " w\n" * rng.randrange(0, 120), "l", rng.choice("aaaaabbc") if i % 40 else None, 1, 2, 3) for i in range(400)]
    rows += [rows[7], rows[7], (None, "w w w", "l", "b", 1, 2, 3), (900, None, "l", "a", 1, 2, 3), (901, "", "l", "nothing", 1, 2, 3), (902, "w " * 3000, "l", "c", 1, 2, 3)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), **options)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "mix_tokens", "mix_epoch", "mix_block", "mix_rank"]
    names = {"target_entropy": "target", "max_repeats": "limit", "budget_tokens": "budget"}
    want = brute_mix(rows, block_tokens=500, **{names[k]: v for k, v in options.items()})
    found = [(r.doc_id, r.source, r.mix_tokens, r.mix_epoch, r.mix_block, r.mix_rank) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_mixing_again_replaces_the_columns(spark):
    rows = [(i, "w " * 40, "l", "ab"[i % 2], 1, 2, 3) for i in range(50)]
    once = mixing.mix(spark.createDataFrame(rows, DOCS))
    twice = mixing.mix(once)
    assert twice.columns == once.columns and sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_mix_of_nothing(spark):
    frame = spark.createDataFrame([], DOCS)
    assert mixing.mix(frame).count() == 0
    one = spark.createDataFrame([(1, "a b", "l", "s", 1, 2, 3)], DOCS)
    assert mixing.mix(one).count() == 1


def brute_top(rows, k=5, every=50):
    import math

    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v, *_ in rows:
        if i is not None and i % every == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            asked[i] = min([v, asked[i]]) if i in asked else v
    out = []
    for i, v in asked.items():
        q = [math.floor(256 * float(x)) for x in v]
        scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in ok if j != i and len(w) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], start=1)]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e7])
def test_top_k_matches_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 60)
    rng = random.Random(6)
    common = [rng.gauss(0, 0.2) * scale for _ in range(10)]
    rows = [(i, common if i % 3 == 0 else [rng.gauss(0, 0.2) * scale for _ in range(10)], 1, 2) for i in range(-60, 400)]
    rows += [(None, common, 1, 2), (1000, None, 1, 2), (1050, [None] * 10, 1, 2), (1100, [float("nan")] * 10, 1, 2), (1150, [float("inf")] * 10, 1, 2)]
    rows += [(1200, [1.0, 2.0], 1, 2), (1201, [3.0, -4.0], 1, 2), (1250, [], 1, 2), (7, rows[3][1], 1, 2), (150, common[::-1], 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    got = topk.top_k(frame).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows))
    assert topk.top_k(frame.limit(0)).count() == 0


def test_bounds_hold_at_every_level():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (50, 13))
    exact = x @ x.T
    for segments in (1, *topk.LEVELS, 99):
        s = topk.segment_statistics(x, segments)
        assert (s @ s.T >= exact - 1e-6).all()
        squared = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        assert (((s[:, None] - s[None]) ** 2).sum(axis=2) <= squared + 1e-6).all()
    # Beyond 62 bits scores are Python's integers.
    assert topk.exact_scores(np.full((1, 4), 2**40), np.full(4, 2**40)).tolist() == [2**82]


def test_large_components_are_exact(spark):
    """Wide vectors take part; ends with an error only where a returned score fits no long."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], 1, 2) for i in range(1, 120) if i % 50]
    rows += [(0, [2.0**-8, 0.0, 1.0], 1, 2), (50, [0.0, 0.0, 2.0], 1, 2), (100, [2.0**52, 3.5, 2.0**-8], 1, 2)]
    rows += [(201, [2.0**54, 2.0, 5.0], 1, 2), (202, [2.0**54 + 4, 0.25, 1.0], 1, 2), (203, [-1e300, 0.0, -3.0], 1, 2), (204, [2.0**47 + 0.5, 1.0, 1.0], 1, 2)]
    frame = spark.createDataFrame([r for r in rows if r[0] != 100], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    assert sorted(map(tuple, topk.top_k(frame).collect())) == sorted(brute_top([r for r in rows if r[0] != 100]))
    with pytest.raises(Exception, match=r"the score of 100 and \d+ does not fit a long"):
        topk.top_k(spark.createDataFrame(rows, frame.schema)).collect()


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, items = bench(5)
    names = "doc_id text lang source n_chars".split()
    rng = random.Random(8)
    prose = lambda n: " ".join(f"p{rng.randrange(3000)}" for _ in range(n))
    shared = prose(60)
    rows = [(i, prose(60), "l", rng.choice("ab"), 0) for i in range(100, 180)]
    rows += [(i, rows[i - 200][1], "l", "a", 0) for i in range(200, 210)] + [(i, f"{prose(40)} {shared} {prose(30)}", "l", "b", 0) for i in range(300, 306)]
    rows += [(400 + i, prose(20) + " you idiot " + prose(3), "l", "a", 0) for i in range(60)]
    rows += [(d, t, lang, s, n) for d, t, lang, s, n, *_ in docs if d is not None and d >= 0][:40]
    rows = list({r[0]: r for r in rows}.values())
    labels = [(r[0], 1, int("idiot" in r[1])) for r in rows]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(f"{folder}/stage{i}")
        after = spark.read.parquet(f"{folder}/stage{i}")
        seen.append((before.collect(), after.collect()))
        assert after.columns[:5] == names and (i == 4 or len(after.columns) == 5)
        before = after
    clean = {r.doc_id for r in seen[0][1]}
    assert clean == {r[0] for r in rows if "idiot" not in r[1]}
    kept = {r.doc_id for r in seen[1][1]}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(spark.read.parquet(f"{folder}/stage0")).collect()}
    root = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert kept == set(root.values())
    first = {}
    for r in sorted(seen[2][0], key=lambda r: r.doc_id):
        words = r.text.split()
        gone = set()
        for i in range(len(words) - 19):
            if first.setdefault(tuple(words[i : i + 20]), (r.doc_id, i)) != (r.doc_id, i):
                gone |= set(range(i, i + 20))
        out = next(o for o in seen[2][1] if o.doc_id == r.doc_id)
        assert out.text.split() == [w for i, w in enumerate(words) if i not in gone] and out.n_chars == len(out.text)
    bad = {w[0] for w in brute_contamination([tuple(r) for r in seen[3][0]], items) if w[-1]}
    assert {r.doc_id for r in seen[3][1]} == {r.doc_id for r in seen[3][0]} - bad and bad
    want = brute_mix([tuple(r) for r in seen[4][0]])
    assert sorted((r.doc_id, r.mix_epoch, r.mix_rank) for r in seen[4][1]) == sorted((w[0], w[3], w[5]) for w in want)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, seen[4][1]))
