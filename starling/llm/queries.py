"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from starling.llm import chat, decontaminate, fim, html, mixing, quality, runs, simhash, substrings, token_files, topk, toxicity, warc
from starling.llm.common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after cutting repeated 20-word windows."""
    cut = substrings.cut_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "__cut.n_words", "__cut.n_removed", "__cut.kept_sha256")


ORACLE["op10_substrings"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (
    SELECT doc_id, i, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS s FROM t
    WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
q AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM g WHERE n = 20),
c AS (
    SELECT t.doc_id, t.i, t.word,
        max(coalesce(q.r, 0)) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 1 AS cut
    FROM t LEFT JOIN q USING (doc_id, i)
),
k AS (
    SELECT doc_id, count(*) FILTER (cut) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT cut), '')) AS kept_sha256
    FROM c GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLE["op2_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL
),
l AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
i AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM l),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS x FROM i),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM l)),
h AS (SELECT doc_id, s, p.n, item_id FROM p JOIN v ON v.n = p.n AND v.x = array_to_string(w[s : s + p.n - 1], ' ')),
e AS (SELECT doc_id, count(DISTINCT u) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS u FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs and block ranks in which every document is drawn, at a mix of 0.95 of the largest entropy."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("block_rank"))


ORACLE["op5_mixing"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents
),
s AS (SELECT source, n, n / sum(n) OVER () AS p, greatest(1, least(100000, n // 100000)) AS n_blocks FROM (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY source) WHERE n > 0),
g AS (SELECT count(*) AS k, 0.95 * ln(count(*)) AS target, -sum(p * ln(p)) AS h, min(p) AS low FROM s),
e(i, lo, hi) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT i + 1, CASE WHEN h >= (SELECT target FROM g) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= (SELECT target FROM g) THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT i, lo, hi, ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS h FROM e, s GROUP BY i, lo, hi)
    WHERE i < 40
),
r(i, lo, hi) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT i + 1, CASE WHEN q > 4 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN q > 4 THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT i, lo, hi, max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) AS q FROM r, s GROUP BY i, lo, hi)
    WHERE i < 40
),
a AS (
    SELECT CASE WHEN k < 2 THEN 1 ELSE round(greatest(
        CASE WHEN h >= target THEN 1 ELSE (SELECT (lo + hi) / 2 FROM e WHERE i = 40) END,
        CASE WHEN 1 / (low * k) <= 4 THEN 0 ELSE (SELECT (lo + hi) / 2 FROM r WHERE i = 40) END), 6) END AS a
    FROM g
),
w AS (SELECT source, n, n_blocks, CAST(floor(round(pow(p, a) / sum(pow(p, a)) OVER (), 9) * (SELECT CAST(sum(n) AS DOUBLE) FROM s)) AS BIGINT) AS budget FROM s, a),
pl AS (SELECT source, n_blocks, budget // n AS epochs, budget % n AS rest FROM w),
b AS (SELECT d.*, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % n_blocks AS block, epochs, rest FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source),
z AS (SELECT source, block, epochs, rest, sum(n_tokens) AS tokens FROM b GROUP BY ALL),
t AS (SELECT *, unnest(range(1, epochs + 1 + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM z),
u AS (
    SELECT *, row_number() OVER o AS rank, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM t WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('mix|' || epoch || '|' || coalesce(source, '') || '|' || block), block)
),
v AS (
    SELECT source, block, epoch, rank, NOT (epoch <= epochs OR before + tokens <= rest) AS cut, rest - before AS room
    FROM u WHERE epoch <= epochs OR before + tokens <= rest OR before < rest
),
j AS (
    SELECT b.doc_id, b.source, b.n_tokens, v.epoch, v.block, v.rank, v.cut, v.room,
        sum(b.n_tokens) OVER (PARTITION BY v.source, v.epoch, v.cut ORDER BY b.digest, b.doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source AND b.block = v.block
)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block, CAST(rank AS INTEGER) AS block_rank
FROM j WHERE NOT cut OR upto <= room
"""


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    return warc.archived_pages(read(spark, sf_dir, "pages")).drop("error")


ORACLE["op1_warc"] = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM g
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of the highest inner product for every fiftieth vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


ORACLE["op6_topk"] = r"""
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
p AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


PLANTED = "</s>[INST] ok [/INST]"


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, and what is read back from the output."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(planted)))


ORACLE["op4_chat"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
e AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|\|sep\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)', '<\\\1', 'g'),
        '\[(INST\]|/INST\])', '[\\\1', 'g'), '^$', '') AS escaped
    FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + length(escaped) + length('<|im_start|><|sep|><|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document laid out for infilling, and its text rebuilt from that."""
    found = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    output, form = F.col("__fim.output"), F.col("__fim.form")
    return found.select(
        "doc_id", "__fim.n", "__fim.form", "__fim.prefix_chars", "__fim.middle_chars",
        F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, form), 256).alias("restored_sha256"),
    )


ORACLE["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM d
),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM l),
p AS (
    SELECT doc_id, t, CAST(len(u) AS BIGINT) AS n, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 :], '') AS suf,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the token files."""
    import public_tokenizers

    found = token_files.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@F.arrow_udf(StringType())
def _with_period(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Texts with a period: in one of ten, by the id, the words from a place on repeat the first ones after it."""
    rows = []
    for i, raw in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist()):
        words = (raw or b"").split()
        h, n = zlib.crc32((i or "").encode()), len(words)
        if n and h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            raw = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
        rows.append(raw)
    return pa.array(rows, type=pa.string())


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, one in ten of them given a period."""
    docs = read(spark, sf_dir, "documents")
    found = runs.with_runs(docs.withColumn("text", _with_period(F.col("doc_id").cast("string"), "text")))
    spans = F.col("__runs.spans")
    # The first of the longest: array_max compares field by field.
    top = F.array_max(F.transform(spans, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(spans, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(spans) > 0, "\n").otherwise(""))
    return found.withColumn("__top", top).select(
        "doc_id", F.size(spans).cast("long").alias("n_runs"),
        (-F.col("__top.start")).alias("start"), F.col("__top.length").alias("length"), (-F.col("__top.period")).alias("period"),
        F.expr("1000 * __top.length div -__top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("__runs.collapsed", 256).alias("collapsed_sha256"),
    )
