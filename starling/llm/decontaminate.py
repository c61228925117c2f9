"""Benchmark decontamination by k-grams, in DataFrame operations only.

Documents hash the k-grams at every ``span - k + 1``-th place, the benchmark those at
every place of its windows, so any shared run of ``span`` words leaves a shared
fingerprint. Fingerprints are joined; in documents with a hit, the words around
each hit are extended to whole windows and compared word by word with the
benchmark's windows. Benchmark items shorter than ``span`` words are one window
of their own length, with a step of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import measured
from starling.session import cut_lineage

SPAN = 13
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then runs of letters, digits and everything beyond ASCII; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _gram(words: Column, length: int, at: Column) -> Column:
    """Hash of the k-gram at a place, for windows of ``length`` words."""
    return F.xxhash64(F.lit(length), F.slice(words, at + 1, min(GRAM, length)))


def _places(words: Column, length: int, step: int = 1) -> Column:
    """Every ``step``-th place that holds a k-gram."""
    last = F.size(words) - min(GRAM, length)
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _step(length: int) -> int:
    """Of so many places in a row, all within a window of ``length`` words, one is a multiple of this."""
    return length - min(GRAM, length) + 1


def _marks(words: Column, length: int) -> Column:
    """Distinct k-gram hashes of all places: those a benchmark window may be met by."""
    return F.array_distinct(F.transform(_places(words, length), lambda i: _gram(words, length, i)))


def _fingerprints(words: Column, length: int) -> Column:
    """Distinct k-gram hashes of the places that are multiples of the step: every window holds one."""
    return F.array_distinct(F.transform(_places(words, length, _step(length)), lambda i: _gram(words, length, i)))


def _windows(words: Column, length: int, at: Column) -> Column:
    """Structs of window length, start and text for each start in ``at``."""
    return F.transform(at, lambda s: F.struct(F.lit(length).alias("length"), s.alias("start"), F.array_join(F.slice(words, s + 1, length), " ").alias("window")))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``(item_id, length, window)``; items without id or words have none."""
    worded = cut_lineage(items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")))
    n = F.size("words")
    length = F.least(n, F.lit(span))
    rows = worded.where(n > 0).select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), n - length)).alias("s"))
    return rows.select("item_id", "length", F.array_join(F.slice("words", F.col("s") + 1, F.col("length")), " ").alias("window")).distinct()


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, share: int = 20
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)`` of every row of ``docs``.

    A document word is hit if it lies in any occurrence of any benchmark window;
    ``items`` are the sorted ids, as strings, of the items with occurring
    windows; a document is contaminated if at least one in ``share`` of its
    words is hit. Null and empty texts have no words and are clean. Items with a
    null id or without words take no part, repeated items count once. Repeated
    rows get equal results, null ids are kept, other columns are not looked at.
    An empty benchmark leaves every document clean.
    """
    targets = cut_lineage(benchmark_windows(items, item_id, item_text, span))
    lengths = sorted(r["length"] for r in targets.select("length").distinct().collect())
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    if not lengths:
        hits = docs.sparkSession.createDataFrame([], "key_id long, key_hash long, start int, length int, item_id string")
    else:
        hits = _hits(keyed, targets, lengths)
    hits = cut_lineage(hits)
    per_key = Window.partitionBy("key_id", "key_hash").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key_id", "key_hash", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    fresh = F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(per_key), F.lit(0)))
    covered = spans.select("key_id", "key_hash", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("key_id", "key_hash").agg(F.sum("fresh").alias("n_hit"))
    found = hits.select("key_id", "key_hash", "item_id").distinct().groupBy("key_id", "key_hash").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    results = cut_lineage(covered.join(found, ["key_id", "key_hash"]))
    size = results.agg(F.sum(64 + 24 * F.size("items"))).first()[0]
    counted = keyed.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    joined = counted.join(measured(results, size), F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def _hits(keyed: DataFrame, targets: DataFrame, lengths: list[int]) -> DataFrame:
    """Occurrences ``(key_id, key_hash, start, length, item_id)`` of the target windows."""
    parts = [targets.where(F.col("length") == n).select(F.explode(_marks(F.split("window", " "), n)).alias("print")) for n in lengths]
    marks = parts[0]
    for part in parts[1:]:
        marks = marks.unionByName(part)
    marks = cut_lineage(marks.distinct())
    prints = keyed.select("doc_id", "text_hash", F.explode(F.concat(*(_fingerprints(F.col("words"), n) for n in lengths))).alias("print"))
    matched = prints.join(measured(marks, 24 * marks.count()), "print", "left_semi")
    candidates = cut_lineage(matched.groupBy(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).agg(F.collect_set("print").alias("prints")))
    size = candidates.agg(F.sum(64 + 8 * F.size("prints"))).first()[0]
    near = keyed.join(measured(candidates, size), F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")))

    def starts(n: int) -> Column:
        """Starts of the windows that hold a hit k-gram."""
        reach, last = n - min(GRAM, n), F.size("words") - n
        hit = F.filter(_places(F.col("words"), n, _step(n)), lambda i: F.array_contains("prints", _gram(F.col("words"), n, i)))
        around = F.transform(hit, lambda p: F.sequence(F.greatest(p - reach, F.lit(0)), p))
        return F.filter(F.array_distinct(F.flatten(around)), lambda s: s <= last)

    windows = F.concat(*(_windows(F.col("words"), n, starts(n)) for n in lengths))
    rows = near.select("key_id", "key_hash", F.explode(windows).alias("w")).select("key_id", "key_hash", "w.*").distinct()
    size = targets.agg(F.sum(F.length("window") + 48)).first()[0]
    return rows.join(measured(targets, size), ["length", "window"]).select("key_id", "key_hash", "start", "length", F.col("item_id").cast("string").alias("item_id"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows; all columns are kept."""
    found = contamination(docs, items, id_col, text_col, **options).where("contaminated")
    bad = cut_lineage(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash"))
    return docs.join(measured(bad, 32 * bad.count()), same, "left_anti")
