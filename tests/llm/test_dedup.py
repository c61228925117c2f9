"""SimHash near-duplicates and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from starling.llm import simhash, substrings
from starling.llm.common import utf8

DOCS = "doc_id long, text string, fp string, name int"
WORDS = [f"w{i}" for i in range(40)]


def make_docs(seed, n=60, repeats=True):
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(60)]
    docs = [None, "", " \t ", "one", "two words", "x " * 50, "x " * 50 + "y", "A b C d\ne f"]
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.5:
            a = rng.randrange(0, 40)
            words[rng.randrange(len(words)) :] = passage[a : a + rng.randrange(10, 60)] + words[:30]
        if docs[-1] and rng.random() < 0.4:
            words = docs[-1].split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(WORDS)] * rng.randrange(2, 45)
        docs.append(rng.choice([" ", "  ", "\n"]).join(words))
    rows = [(i * 3, t, "own", i) for i, t in enumerate(docs)]
    if repeats:
        rows += [rows[12], rows[12], (None, docs[15], "own", 0), (None, "only here " * 12, "own", 0), (rows[20][0], docs[25], "own", 0)]
    return rows


def brute_print(text, k=3):
    words = utf8(text).lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, bits=3):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= bits:
                    label[i] = label[j] = min(label[i], label[j])
    return [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_simhash_matches_brute_force(spark):
    rows = make_docs(1)
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints, [r[0] for r in rows])
    assert got == sorted((r[0] is None, r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, roots))


def test_keep_one_leaves_one_of_each_group(spark):
    for repeats in (False, True):
        rows = make_docs(2, repeats=repeats)
        roots = brute_components([brute_print(r[1]) for r in rows], [r[0] for r in rows])
        kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
        groups = {c if c is not None else ("null", brute_print(r[1])) for r, c in zip(rows, roots)}
        assert len(kept) == len(groups)
        assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c in roots if c is not None}
        assert kept[0].__fields__ == ["doc_id", "text", "fp", "name"]


@pytest.mark.parametrize("n", [100, 1 << 24])
def test_bucket_links_join_what_is_close(n, spark):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 30, dtype=np.int64)
    flips = np.array([np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.integers(0, 63, rng.integers(0, 3)))) if k else 0 for k in range(10)], dtype=np.int64)
    prints = sorted({int(c ^ f) for c in centers for f in flips} | {0, -1, 7, 15})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    blocks, sets = simhash._tables(n, 3)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                assert any(not any((a ^ b) >> edges[k] & ((1 << edges[k + 1] - edges[k]) - 1) for k in chosen) for chosen in sets)
    links = {(r.u, r.v) for r in simhash.near_links(nodes).collect()}
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 3 and u > v for u, v in links)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[find(u)] = find(v)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            assert ((a ^ b) & (2**64 - 1)).bit_count() > 3 or find(a) == find(b)


def test_tiles_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    prints = [1 << i for i in range(20)] + [0]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    seen = {0}
    while new := {x for r in links for x in (r.u, r.v) if {r.u, r.v} & seen} - seen:
        seen |= new
    assert seen == set(prints)


def brute_cut(rows, window=20):
    docs = sorted({(r[0] is None, r[0] or 0, hashlib.md5(utf8(r[1])).hexdigest() if r[1] is not None else "", r[1]) for r in rows}, key=lambda d: d[:3])
    first, cut = {}, {}
    for d in docs:
        words = utf8(d[3]).split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in first:
                gone[i : i + window] = [True] * window
            first.setdefault(key, (d, i))
        kept = [w for w, g in zip(words, gone) if not g]
        cut[d[0], d[1], d[3]] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return [cut[r[0] is None, r[0] or 0, r[1]] for r in rows]


@pytest.mark.parametrize("seed,window", [(1, 20), (4, 20), (5, 13), (6, 24)])
def test_cut_repeats_matches_brute_force(spark, seed, window):
    rows = make_docs(seed, n=120, repeats=seed != 5)
    found = substrings.cut_repeats(spark.createDataFrame(rows, DOCS).repartition(3), window).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.name, *r["__cut"][1:]) for r in found)
    assert got == sorted((r[0] is None, r[0], r[3], *c) for r, c in zip(rows, brute_cut(rows, window)))
    assert all(r["__cut"].text == r.text for r in found if r["__cut"].n_removed == 0)


def test_small_chunks_find_the_same(spark):
    rows = [r for r in make_docs(7, n=80, repeats=False) if r[1]]
    words = [utf8(r[1]).split() for r in rows]
    keys = [r[0] for r in rows]
    whole = substrings.Chunk(keys, words, 20)
    names = {}
    for group in ([0, 1, 2], list(range(3, len(rows)))):
        part = substrings.Chunk([keys[i] for i in group], [words[i] for i in group], 20)
        low = list(part.levels())[substrings.LOW_ROUNDS - 1]
        anchor, _ = part.anchors(low)
        for s, a in zip(part.starts, anchor):
            key, pos = part.place(np.array([s]))
            names[int(key[0]), int(pos[0])] = int(a - s)
    anchor, _ = whole.anchors(list(whole.levels())[substrings.LOW_ROUNDS - 1])
    by_text = {}
    for s, a in zip(whole.starts, anchor):
        key, pos = whole.place(np.array([s]))
        assert names[int(key[0]), int(pos[0])] == a - s
        by_text.setdefault(bytes(whole.words[s : s + 20]), set()).add(int(a - s))
    assert all(len(v) == 1 for v in by_text.values())


def test_cut_words_keeps_the_rest_as_it_is():
    assert substrings.cut_words("  a b\n\nc  d ", [1], [2])[0] == "  a c  d "
    assert substrings.cut_words("  a b\n\nc  d ", [0, 3], [2, 4])[:3] == ("  c  ", 4, 3)
    assert substrings.cut_words(None, None, None)[:3] == (None, 0, 0)


def test_marks_pack_and_unpack():
    keys, own = np.array([3, 5, 8, 9]), np.array([3, 3, 3, 8, 8, 9, 9])
    values = np.array([0, 7, 200_000, 65535, 131070, 65534, 65536])
    packed = substrings._packed(keys, own, values).to_pylist()
    assert [substrings.unpacked(p).tolist() for p in packed] == [[0, 7, 200_000], [], [65535, 131070], [65534, 65536]]
    assert substrings._packed(keys[:0], own[:0], values[:0]).to_pylist() == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert substrings.cut_repeats(empty).count() == 0
