"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments. From the segments' sums and deviations follows a
lower bound of the distance of two vectors, so with their lengths an upper bound
of their inner product. Bounds are taken coarse to fine; what can still reach
the k best seen so far goes on, and survivors get their exact integer score.

Queries come in blocks, vectors in chunks. A bounded hashed sample of vectors
gives each query a first score that its k-th best cannot fall below; the sample
speeds the search up and does not change its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import measured
from starling.session import cut_lineage

SCALE = 256
LEVELS = (2, 8)
CHUNK_ROWS = 4096
BLOCK_QUERIES = 256
SAMPLE_ROWS = 2048
# Chunks are dealt over a task each, up to so many tasks.
MAX_TASKS = 20_000

# Marks the data of a pack of vectors whose integers need more than 62 bits.
WIDE = b"W"
PACK_SCHEMA = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def _is_wide(vector: np.ndarray) -> bool:
    return bool(len(vector)) and float(np.abs(vector).max()) >= 2.0**62 / SCALE


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component: longs, or Python integers (an object array) where one needs more bits."""
    if not vectors.size or np.abs(vectors).max() < 2.0**62 / SCALE:
        return np.floor(SCALE * vectors).astype(np.int64)
    # From 2^52 on a double is an integer by itself.
    wide = [int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(SCALE * x)) for x in vectors.ravel().tolist()]
    return np.array(wide, dtype=object).reshape(vectors.shape)


def _packed(ids: list[int], vectors: list) -> pa.RecordBatch:
    values = np.array(vectors, dtype=np.float64).reshape(len(ids), -1)
    data = to_integers(values)
    if data.dtype == object:
        raw = WIDE + values.tobytes()
    else:
        raw = (data.astype(np.int32) if not data.size or np.abs(data).max() < 2**31 else data).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([values.shape[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([raw], pa.binary())], schema=PACK_SCHEMA)


def _pack(rows: int):
    """Rows (vec_id, embedding) to packs of at most ``rows`` vectors of one dimension, those with wide components apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list]] = {}
        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = len(vector), _is_wide(np.array(vector))
                ids, vectors = held.setdefault(kind, ([], []))
                ids.append(key)
                vectors.append(vector)
                if len(ids) >= rows:
                    yield _packed(ids, vectors)
                    del held[kind]
        for ids, vectors in held.values():
            yield _packed(ids, vectors)

    return run


def unpack(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, dtype=np.int64)
    if data[:1] == WIDE and len(data) == 8 * dim * len(keys) + 1:
        return keys, to_integers(np.frombuffer(data[1:], dtype=np.float64).reshape(len(keys), dim))
    kind = np.int32 if len(data) == 4 * dim * len(keys) else np.int64
    return keys, np.frombuffer(data, dtype=kind).reshape(len(keys), dim)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """For each vector and segment, the sum over the root of the length, and the root of the squared deviations.

    The squared distance of two vectors is at least that of their statistics,
    and the product of two statistics is at least the vectors' inner product.
    """
    x = vectors.astype(np.float64)
    parts = [p for p in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)]
    means = [p.sum(axis=1) / max(1, p.shape[1]) ** 0.5 for p in parts]
    spread = [np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) if p.shape[1] else np.zeros(len(x)) for p in parts]
    return np.stack(means + spread, axis=1)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: longs, or Python integers where one may need more bits."""
    if not vectors.size:
        return np.zeros(len(vectors), np.int64)
    if vectors.dtype != object and query.dtype != object:
        bound = float(np.abs(vectors.astype(np.float64)).max()) * float(np.abs(query.astype(np.float64)).max()) * vectors.shape[1]
        if bound < 2.0**53:
            return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        if bound < 2.0**62:
            return vectors.astype(np.int64) @ query.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors], dtype=object)


class Chunk:
    """Vectors with their statistics at every level; wide ones have none and are all compared."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        self.keys, self.vectors = keys, vectors
        self.bounded = vectors.dtype != object
        if self.bounded:
            self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            self.statistics = [segment_statistics(vectors, s) for s in LEVELS]

    def best(self, key: int, query: np.ndarray, floor: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best rows but ``key``, of those that score ``floor`` or more."""
        at = np.flatnonzero(self.keys != key)
        if floor is not None and self.bounded and query.dtype != object:
            length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
            for stats, segments in zip(self.statistics, LEVELS):
                own = segment_statistics(query[None, :], segments)[0]
                # distance >= distance of the statistics, so score <= (|q|^2 + |x|^2 - that distance) / 2 = product of the statistics
                slack = 1e-9 * length * self.norms[at] + 1e-6
                at = at[stats[at] @ own + slack >= floor]
        scores = exact_scores(self.vectors[at], query)
        if floor is not None:
            high = (scores >= floor).astype(bool)
            at, scores = at[high], scores[high]
        order = np.lexsort((self.keys[at], -scores)) if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-scores[i], self.keys[at[i]])), dtype=int)
        return self.keys[at[order[:k]]], scores[order[:k]]


def fits(score: int) -> bool:
    return -(1 << 63) <= score < 1 << 63


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for ids divisible by ``every`` the k best other rows.

    Ties go to the smaller id; with fewer other rows all are returned. Vectors
    that are null or hold null or non-finite components, and rows without an
    id, take no part; a query meets the vectors of its own dimension. Rows that
    share a query's id are no candidates of it; of several vectors under one
    query id the smallest asks. Repeated rows are candidates of their own.
    Components of any finite size are exact; only a result whose score does
    not fit a long ends the query with an error.
    """
    rows = _valid(vectors, id_col, vector_col)
    pack_type = "dim int, ids binary, data binary"
    chunks = cut_lineage(rows.mapInArrow(_pack(CHUNK_ROWS), pack_type))
    asked = cut_lineage(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["embedding"]), []).append((r["vec_id"], r["embedding"]))
    seeds = {d: Chunk(np.array([i for i, _ in v]), to_integers(np.array([x for _, x in v], dtype=np.float64).reshape(len(v), d))) for d, v in by_dim.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(seeds)
    block_schema = pa.schema([("q_dim", pa.int32()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("floors", pa.list_(pa.int64()))])

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _pack(BLOCK_QUERIES)(batches):
            dim, ids, data = (c[0].as_py() for c in pack.columns)
            keys, queries = unpack(dim, ids, data)
            seed, floors = shared.value.get(dim), []
            for key, query in zip(keys.tolist(), queries):
                found = seed.best(key, query, None, k)[1] if seed else ()
                # the sample's rows have ids of their own only if none repeats
                floors.append(int(found[-1]) if len(found) == k and fits(int(found[-1])) else None)
            yield pa.RecordBatch.from_arrays([*pack.columns, pa.array([floors], block_schema.field("floors").type)], schema=block_schema)

    asked = asked.repartition(blocks, F.col("vec_id"))
    questions = cut_lineage(asked.mapInArrow(with_floors, "q_dim int, q_ids binary, q_data binary, floors array<long>"))
    size = questions.agg(F.sum(F.length("q_ids") + F.length("q_data") + 8 * F.size("floors"))).first()[0]
    out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("fits", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, data, _, q_ids, q_data, floors = (c[i].as_py() for c in batch.columns)
                if last is None or last[0] != ids or last[1] != data:
                    last, chunk = (ids, data), Chunk(*unpack(dim, ids, data))
                q_keys, queries = unpack(dim, q_ids, q_data)
                found = [(key, *chunk.best(key, query, floor, k)) for key, query, floor in zip(q_keys.tolist(), queries, floors)]
                scores = [int(x) for f in found for x in f[2]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                    pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
                    pa.array([max(-(1 << 63), min(x, (1 << 63) - 1)) for x in scores], pa.int64()), pa.array(list(map(fits, scores)), pa.bool_()),
                ], schema=out_schema)

    chunks = chunks.repartition(max(1, min(chunks.count(), MAX_TASKS)))
    pairs = chunks.crossJoin(measured(questions, size)).where(F.col("dim") == F.col("q_dim"))
    scored = pairs.mapInArrow(search, "query_id long, vec_id long, score long, fits boolean")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    too_wide = F.raise_error(F.concat(F.lit("the score of "), F.col("query_id"), F.lit(" and "), F.col("vec_id"), F.lit(" does not fit a long")))
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("fits"), F.col("score")).otherwise(too_wide).alias("score"))
