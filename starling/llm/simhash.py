"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints.

Fingerprints are linked when they differ in at most ``max_bits`` bits. They
meet only in buckets that pigeonhole guarantees (of ``blocks`` blocks of bits,
``blocks - max_bits`` must be equal). Inside a bucket the Hamming distances to
``PIVOTS`` reference fingerprints are tabulated; by the triangle inequality a
pair whose distances to any pivot differ by more than ``max_bits`` cannot be
close and is discarded, and the survivors are verified bit by bit. A bucket
emits only links that join two groups, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starling.llm.common import has_repeats, measured, record_batches, utf8
from starling.operators.components import settle_by_rounds
from starling.session import cut_lineage

SEED = 42
PIVOTS = 32
# Buckets of more fingerprints are dealt over tiles of this many.
TILE = 8192
LINK_SCHEMA = "u long, v long"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half of the shingles' hashes.

    A-Z is lower-cased, words are split at ASCII white space, shingles count
    as often as they occur. Fewer words than ``shingle`` are one shingle; no
    words (null, empty or white text) give 0.
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(batch: pa.RecordBatch) -> list:
        prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return [batch.column(0), prints.view(np.int64)]

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(record_batches(rows, schema), "doc_id long, fp long")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _tables(n: int, max_bits: int) -> tuple[int, list[tuple[int, ...]]]:
    """Blocks, and the block sets that serve as keys, so that buckets stay small for n fingerprints."""
    for blocks in range(max_bits + 1, max_bits + 5):
        equal = blocks - max_bits
        if blocks == max_bits + 4 or (64 // blocks) * equal >= np.log2(max(n, 2)) - 2:
            return blocks, list(combinations(range(blocks), equal))
    raise AssertionError


def _keys(n: int, max_bits: int) -> Column:
    """Array with one bucket key for each table."""
    blocks, sets = _tables(n, max_bits)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for table, chosen in enumerate(sets):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(table).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*keys)


def _pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(PIVOTS)], dtype=np.uint64)


def _bucket_links(group: np.ndarray, prints: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links inside runs of equal ``group`` numbers, enough to join what is close.

    Row i is compared with row i + 1, then i + 2 and so on, for all buckets at
    once; rows already joined need no comparing.
    """
    n = len(prints)
    distance = np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)
    ends = np.searchsorted(group, group, side="right")
    parent, left, right = np.arange(n), [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    active, shift = np.arange(n), 1
    while True:
        active = active[active + shift < ends[active]]
        if not len(active):
            return left, right
        i, j = active, active + shift
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        for k in range(len(pivots)):
            if not len(i):
                break
            near = np.abs(distance[i, k] - distance[j, k]) <= max_bits
            i, j = i[near], j[near]
        close = np.bitwise_count(prints[i] ^ prints[j]) <= max_bits
        joined = False
        for a, b in zip(i[close].tolist(), j[close].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
                joined = True
        while joined:
            flat = parent[parent]
            joined = not np.array_equal(flat, parent)
            parent = flat
        shift += 1


def _link_batches(max_bits: int):
    """Batches sorted by (t, key, tile, fp) to links; a bucket may span batches."""
    pivots = _pivots()
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.ones(len(prints), dtype=bool)
        starts[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        left, right = _bucket_links(np.cumsum(starts), prints, pivots, max_bits)
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(signed[left], signed[right]) if left else [], pa.int64()), pa.array(np.minimum(signed[left], signed[right]) if left else [], pa.int64())], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            prints = batch.column(3).to_numpy().astype(np.int64).view(np.uint64)
            changes = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                done = [*kept, (keys[:cut], prints[:cut])]
                yield links(np.concatenate([k for k, _ in done]), np.concatenate([p for _, p in done]))
                kept = [(keys[cut:], prints[cut:])]
            elif kept and (kept[0][0][0] != keys[0]).any():
                yield links(np.concatenate([k for k, _ in kept]), np.concatenate([p for _, p in kept]))
                kept = [(keys, prints)]
            else:
                kept.append((keys, prints))
        if kept:
            yield links(np.concatenate([k for k, _ in kept]), np.concatenate([p for _, p in kept]))

    return run


def near_links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``(u, v)``, ``u > v``, whose components are those of all close pairs.

    ``nodes`` holds distinct values ``fp``. A bucket with over ``TILE``
    fingerprints is dealt over tiles, each pairing two hashed parts of it, so no
    task holds more than two parts and every pair still meets in one tile.
    """
    n = nodes.count()
    rows = nodes.select("fp", F.explode(_keys(n, max_bits)).alias("k")).select("k.t", "k.key", "fp")
    sizes = rows.groupBy("t", "key").count().where(F.col("count") > TILE)
    large = cut_lineage(sizes.select("t", "key", F.ceil(F.col("count") / TILE).cast("int").alias("parts")))
    if large.limit(1).count():
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
        rows = rows.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("p", part).select("t", "key", "fp", "p", "parts", other)
        rows = rows.select("t", "key", (F.least("p", "o") * F.col("parts") + F.greatest("p", "o")).alias("tile"), "fp")
    else:
        rows = rows.select("t", "key", F.lit(0).alias("tile"), "fp")
    dealt = rows.repartition("t", "key", "tile").sortWithinPartitions("t", "key", "tile", "fp")
    return dealt.mapInArrow(_link_batches(max_bits), LINK_SCHEMA)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. Copies share a fingerprint and count as one node. Null, empty and
    white texts have fingerprint zero and are linked like any other. Rows with
    a null id belong to their component but never name it; if no id is
    reachable it is null. Repeated rows come back repeated, other columns are
    not looked at, an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    stars = settle_by_rounds(cut_lineage(near_links(nodes, max_bits).distinct()))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), "v"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = cut_lineage(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Null ids come last and rows that share an id are ordered by fingerprint, so
    of repeated rows one is left. All columns are kept.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    if not has_repeats(docs, id_col):
        kept = cut_lineage(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")))
        return docs.join(measured(kept, 16 * kept.count()), F.col(id_col).cast("long") == F.col("__kept"), "left_semi")
    groups = found.select("fingerprint", "doc_id", "component_id").groupBy("fingerprint").agg(F.min("component_id").alias("__group"), F.min("doc_id"))
    groups = cut_lineage(groups.select(F.col("fingerprint").alias("__print"), F.coalesce(F.col("__group").cast("string"), F.col("fingerprint")).alias("__group")))

    @F.pandas_udf("string")
    def printed(text: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t, shingle):016x}" for t in text], dtype=object)

    # Only the ids travel until the row to keep is known; a row is named by its id and its text.
    named = docs.withColumn("__own", printed(F.col(text_col))).withColumn("__text", F.coalesce(F.md5(text_col), F.lit("")))
    grouped = named.select(F.col(id_col).cast("long").alias("__id"), "__text", F.col("__own").alias("__print")).join(groups, "__print")
    best = cut_lineage(grouped.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__print", "__text")).alias("b")).select("b.__id", F.col("b.__text").alias("__best")))
    kept = named.join(best, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__best")), "left_semi")
    return kept.dropDuplicates([id_col, "__text"]).drop("__own", "__text")
