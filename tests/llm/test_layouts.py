"""Fill-in-middle layouts, token files and periodic runs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starling.llm import fim, queries, runs, token_files
from starling.llm.boundaries import ArrayContainer, BitmapContainer, BoundarySet, RunContainer

DOCS = "doc_id long, text string, n long, form string, start long"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    """Nulls, empty and long texts, repeated rows, shared ids, marks and line ends of all kinds."""
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\r\nß\n\nx", "pre <P> mid", "<S>", "x\n<M>\ny", "<\nS>\n<\n", "a <S\n> b\n"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(i, f"line {i}\nsecond ç\nthird") for i in range(100, 140)]
    rows += [(5, "one\ntwo\n"), (5, "one\ntwo\n"), (5, "other"), (None, "n\nm"), (None, None), (-3, "x y " * 50)]
    rows += [(200, "\n".join(f"row {i} é" for i in range(60_000))), (201, "\n" * 100_000), (202, "w " * 70_000), (203, "ab\n" * 30_000)]
    return [(i, t, -1, "x", -2) for i, t in rows]


# --------------------------------------------------------------- boundary sets


@pytest.mark.parametrize("offsets, kinds", [
    ([], []),
    ([0], [ArrayContainer]),
    (range(0, 60_000, 7), [BitmapContainer]),
    (range(0, 190_000, 3), [BitmapContainer] * 3),
    (range(70_000, 90_000), [RunContainer]),
    ([*range(0, 65536, 100), *range(65536 * 3, 65536 * 4), 2**31, 2**31 + 5], [ArrayContainer, RunContainer, ArrayContainer]),
])
def test_boundary_sets(offsets, kinds):
    offsets = list(offsets)
    found = BoundarySet(offsets)
    assert [type(c) for c in found.containers] == kinds and len(found) == len(offsets)
    for i in {0, 1, len(offsets) // 2, len(offsets) - 1} & set(range(len(offsets))):
        assert found.select(i) == offsets[i] and found.rank(offsets[i]) == i + 1 and offsets[i] in found
    members = set(offsets)
    for x in (-1, 0, 1, 69_999, 70_001, 65536 * 3 - 1, 2**31 + 4):
        assert found.rank(x) == sum(o <= x for o in offsets) and (x in found) == (x in members)
    with pytest.raises(IndexError):
        found.select(len(offsets))


@given(st.sets(st.integers(0, 300_000), max_size=300), st.integers(0, 300_000), st.integers(0, 5000))
@settings(max_examples=60, deadline=None)
def test_boundary_sets_of_any_members(members, head, run):
    offsets = sorted(members | set(range(head, head + run)))
    found = BoundarySet(offsets)
    assert [found.select(i) for i in range(len(offsets))] == offsets
    assert all(found.rank(o) == i + 1 for i, o in enumerate(offsets))


# -------------------------------------------------------------- fill in middle


def plain_layout(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return len(units), "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_layouts_against_plain_cuts(spark):
    rows = odd_rows()
    found = fim.fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(3))
    assert found.columns == ["doc_id", "text", "n", "form", "start", "__fim"]
    got = found.withColumn("back", fim.restored(F.col("__fim.output"), F.col("__fim.form"))).collect()
    want = sorted(((i, t) + plain_layout(i, t or "") for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.text, *r["__fim"]) for r in got), key=repr) == want
    assert all(r.back == (r.text or "") for r in got)
    assert {r["__fim"].form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_of_forms(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    share = {r.form: r["count"] for r in fim.fill_in_middle(docs, fim_percent=50, spm_percent=0).groupBy("__fim.form").count().collect()}
    assert set(share) == {"plain", "psm"} and 1350 < share["plain"] < 1650


# ----------------------------------------------------------------- token files


WHOLE = Tokenizer.from_file(VOCABULARY)


def whole_ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def token_rows():
    words = "The café's <|endoftext|> ﬁne x<|startoftext|>y don't 12,345 Straße ÅÅ é ́x 漢字  nb em".split(" ")
    rng = random.Random(4)
    return odd_rows() + [(1000 + i, rng.choice([" ", "\n", " \t", "\r\n"]).join(rng.choices(words, k=rng.randrange(60))), 0, "", 0) for i in range(300)]


def test_token_files_round_trip(spark, tmp_path, token_rows):
    folder = str(tmp_path / "t")
    docs = spark.createDataFrame(token_rows, DOCS).repartition(3)
    token_files.write_tokens(docs, folder, VOCABULARY, file_tokens=100_000)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    lists = {t: whole_ids(t or "") for t in {r[1] for r in token_rows}}
    coded = [(i, lists[t]) for i, t, *_ in token_rows]
    want = sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded)
    assert [(r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [w[2] for w in want])[:-1].tolist()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, ids) for i, ids in coded)
    assert len(list((tmp_path / "t" / "ids").glob("*.orc"))) > 2


def test_word_wise_ids_are_those_of_whole_texts(token_rows):
    encoder = token_files.Encoder(VOCABULARY)
    for _, text, *_ in token_rows[-300:] + token_rows[:13]:
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == whole_ids(text or "")


@given(st.text(alphabet="aBt'slé\u0301ÀÿµØ \t\n\x0b\x0c\r\x00\x1c\x7f\x85\xa0\u2003Σς1<|>.-", max_size=40))
@settings(max_examples=300, deadline=None)
def test_word_wise_ids_of_any_text(text):
    assert np.frombuffer(token_files.Encoder(VOCABULARY).encode(text), "<u4").tolist() == whole_ids(text)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 10)
    encoder = token_files.Encoder(VOCABULARY)
    for text in ("a b c d e f", "g h i j k l m", "a g " * 5, " ".join(map(str, range(50))), "a"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole_ids(text)


def test_whole_text_tokenizers(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(2, "a  b"), (1, " x\n\ny"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, token_files.token_files(docs, path, str(tmp_path / "t"), end_id=50256).select("doc_id", "ids").collect()))
    assert got == [(i, [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 50256]) for i, t in ((1, " x\n\ny"), (2, "a  b"), (3, ""))]


def test_empty_token_files(spark, tmp_path):
    found = token_files.token_files(spark.createDataFrame([], DOCS), VOCABULARY, str(tmp_path / "t"))
    assert found.collect() == [] and found.columns == ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]


def scanned(df):
    """Rows the scans of the ids gave to the rest of the plan, and the result."""
    rows = df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        if node.nodeName().startswith("Scan orc"):
            total = max(total, node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total, rows


def test_stripes_are_read_in_parallel_and_skipped(spark, tmp_path):
    folder = str(tmp_path / "t")
    docs = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *(F.sha1((F.col("id") + i).cast("string")) for i in range(4))).alias("text"))
    token_files.write_tokens(docs, folder, VOCABULARY, file_tokens=1 << 40, stripe_bytes=1 << 18)
    files = sorted((tmp_path / "t" / "ids").glob("*.orc"))
    assert sum(orc.ORCFile(f).nstripes for f in files) > 2 * len(files)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = token_files.read_tokens(spark, folder)
        assert rows.groupBy(F.spark_partition_id()).count().count() > 2 * len(files)
        assert rows.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    seen, found = scanned(token_files.read_tokens(spark, folder, [20_002]))
    assert [r.doc_id for r in found] == [20_002] and 0 < seen <= 2000
    seen, found = scanned(token_files.read_tokens(spark, folder, [20_001]))  # between two ids: only the Bloom filter knows
    assert found == [] and seen <= 1000


def test_damaged_ids_are_found(spark, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), folder, VOCABULARY)
    rows = spark.read.orc(f"{folder}/ids")
    rows.withColumn("ids", F.when(F.col("doc_id") == 2, F.array(F.lit(7), F.lit(1))).otherwise(F.col("ids"))).write.orc(str(tmp_path / "d" / "ids"))
    spark.read.orc(f"{folder}/parts").write.orc(str(tmp_path / "d" / "parts"))
    with pytest.raises(Exception, match="damaged ids of document 2"):
        token_files.read_tokens(spark, str(tmp_path / "d")).collect()


# ---------------------------------------------------------------- periodic runs


def plain_lyndon(s):
    def longest(i):
        return max(k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[j : i + k] for j in range(i + 1, i + k)))

    return [longest(i) for i in range(len(s))]


def plain_runs(w, min_length):
    found = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            first = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - first + p
            part = w[first : first + n]
            smallest = i > first and not any(all(part[k] == part[k + q] for k in range(n - q)) for q in range(1, p))
            if smallest and n >= max(min_length, 2 * p):
                found.append((first, n, p))
            i += i == first
    return sorted(found, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 3), max_size=16))
@settings(max_examples=300, deadline=None)
def test_lyndon_lengths(symbols):
    assert runs.lyndon_lengths(symbols) == plain_lyndon(symbols)


def random_documents(rng, count):
    for _ in range(count):
        n, k = rng.randrange(70), rng.randrange(1, 6)
        words = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
        yield words


@pytest.mark.parametrize("min_length", [2, 5, 12])
def test_runs_against_plain_search(min_length):
    documents = list(random_documents(random.Random(min_length), 400))
    got = [list(map(tuple, f.tolist())) for f in runs.runs_of_documents(documents, min_length)]
    assert got == [plain_runs(d, min_length) for d in documents]


def test_runs_when_hashes_collide():
    word = [0]
    while len(word) < 4096:
        word += [1 - x for x in word]
    s = np.array(word + word[:100] * 3)
    found = runs.find_runs(s)
    assert runs._holds(s, found)
    roots = [np.array(runs.lyndon_lengths(x.tolist())) for x in (s, -s)]
    assert np.array_equal(found, runs._extended(s, roots, runs.PlainExtensions(s), 12))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words, 12)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query_against_plain_search(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(i, t) for i, t, *_ in odd_rows() if not t or len(t) < 5000]
    rows += [(2000 + i, " \n"[i % 2].join(f"w{x}" for x in d)) for i, d in enumerate(random_documents(rng, 300))]
    rows += [(-i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(200))) for i in range(1, 60)]
    rows += [(5000, "a b c " * 300), (5000, "a b c " * 300), (5001, "x " * 12), (5002, "x " * 11), (5003, "ab\x1ccd  " * 20)]
    frame = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, spans string, length int")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(runs, "GROUP_WORDS", 500)
    got = sorted(map(tuple, queries.op13_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert any(r[1] > 1 for r in got)


def test_runs_keep_columns_and_take_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a " * 20, "keep")], "doc_id long, text string, spans string")
    row = runs.with_runs(frame).first()
    assert row.spans == "keep" and row["__runs"].collapsed == "a" and [tuple(s) for s in row["__runs"].spans] == [(0, 20, 1)]
    assert runs.with_runs(frame.limit(0)).collect() == []


def test_runs_of_a_long_text(spark):
    words = [f"w{i % 977}" if 50_000 < i < 200_000 else f"u{i}" for i in range(400_000)]
    row = runs.with_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()["__runs"]
    assert row.n_words == 400_000 and [tuple(s) for s in row.spans] == [(50_001, 149_999, 977)]
