"""Token ids in ORC files: documents in id order, each file cut into stripes with row indexes and Bloom filters."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from starling.llm.common import measured, short_batches
from starling.session import cut_lineage, scratch_path

END_ID = 1
# Ids of a file, ids below which a file is not worth a task of its own, bytes of a stripe, rows of a row index entry.
FILE_TOKENS = 1 << 26
SMALL_FILE_TOKENS = 1 << 20
STRIPE_BYTES = 32 << 20
INDEX_ROWS = 1000
BLOOM_FALSE_POSITIVES = 0.01
# Words a worker remembers the ids of.
MEMO_WORDS = 1 << 19

_PACKED = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *list(_PACKED)[2:], ("part", pa.int32()), ("start_in_part", pa.int64())])
_FILE_SQL = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, part int, start_in_part long"

# The normalizer and pre-tokenizer of vocabularies of lower-case words without white space.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Words of printable ASCII and Latin-1 letters, and what that pattern is for them in lower case.
_PLAIN_WORD = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+")
_WORD = re.compile(r"[^ \t-\r]+")
# White space to Python, but not to Unicode.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The library's tokenizer of a file, and whether words can be encoded one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    plain = parts["normalizer"] == WORD_NORMALIZER and parts["pre_tokenizer"] == WORD_SPLITTER
    marks = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in parts["added_tokens"])
    return Tokenizer.from_file(path), plain and marks and not parts["post_processor"]


class Encoder:
    """Texts to the bytes of their ids, little-endian and 32 bits each, the end id last.

    Most vocabularies see a text's white space, so they are given whole texts.
    One that drops it (``WORD_NORMALIZER``, ``WORD_SPLITTER``) gives a text the
    ids of its words, so words are encoded once and remembered; plain words go
    to the library's model piece by piece.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        self.tokenizer, self.word_wise = _tokenizer(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.words = _Words(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if not self.word_wise:
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        if len(self.words) > MEMO_WORDS:
            self.words = _Words(self.tokenizer)
        words = _WORD.findall(text) if any(c in text for c in _SEPARATORS) else text.split()
        return b"".join(map(self.words.__getitem__, words)) + self.end


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Words(dict):
    """The ids' bytes of words, encoded when first asked for."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model, self.pieces = tokenizer, tokenizer.model, {}
        # How the library writes the bytes of a letter beyond ASCII.
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}

    def __missing__(self, word: str) -> bytes:
        if _PLAIN_WORD.fullmatch(word) and "<|" not in word:
            found = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECE.findall(word.lower())])
        else:
            found = _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() else piece.translate(self.written)
        found = self.pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
        return found


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    return Encoder(path, end_id)


def _id_lists(raw: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"), type=pa.int32()))


def _encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, packed, n_tokens, ids_crc32)`` of every row, ``packed`` the ids' bytes as a Zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = _encoder(path, end_id), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            raw = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = [[pack(r) for r in raw], [len(r) // 4 for r in raw], [zlib.crc32(r) for r in raw]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(_PACKED)[1:]))], schema=_PACKED)

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, packed binary, n_tokens long, ids_crc32 long")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with the partition's number and the ids before each row in it."""
    part, before, unpack = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        counts = batch.column("n_tokens").to_numpy()
        ends = before + np.cumsum(counts)
        ids = _id_lists([unpack(p) for p in batch.column("packed").to_pylist()])
        places = [pa.array(np.full(len(counts), part), type=pa.int32()), pa.array(ends - counts, type=pa.int64())]
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, batch.column("n_tokens"), batch.column("ids_crc32"), *places], schema=_PLACED)


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    file_tokens: int = FILE_TOKENS, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS,
) -> None:
    """Encode every text with the tokenizer file ``path`` and write the ids below ``folder``.

    ``folder/ids`` holds ORC files of rows in ascending id order, file after
    file; null texts count as empty, null ids come first, rows of one id follow in the order of their
    length and checksum, and equal rows in any order. Ids of tokens are an
    integer column, so stripes hold them run-length encoded; each stripe has a
    row index and Bloom filters of document ids. ``folder/parts`` holds the
    ids before each file. The range shuffle splits by all sort columns, so one
    id with many rows still spreads over files.
    """
    spark = docs.sparkSession
    step = cut_lineage(_encoded(docs, path, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    total = step.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // file_tokens), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SMALL_FILE_TOKENS)))
    keys = ["doc_id", "n_tokens", "ids_crc32", "row"]
    placed = step.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("row").mapInArrow(_place, _FILE_SQL)
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FALSE_POSITIVES, "orc.create.index": "true",
        "orc.row.index.stride": max(1000, index_rows), "orc.stripe.size": stripe_bytes, "compression": "zstd",
    }
    placed.write.options(**{k: str(v) for k, v in options.items()}).orc(f"{folder}/ids")
    sums = spark.read.schema(_FILE_SQL).orc(f"{folder}/ids").groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row per file.
    earlier = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums.withColumn("part_start", F.coalesce(earlier, F.lit(0))).coalesce(1).write.orc(f"{folder}/parts")


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    values, offsets = np.asarray(ids.values).astype("<u4", copy=False), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], type=pa.int64())


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids, ids_crc32)`` from the files; ``start`` counts the ids of all documents before.

    Tasks read stripes of their own. With ``doc_ids`` only those documents:
    statistics and Bloom filters skip stripes and row groups that cannot hold
    them. The checksum is taken of the ids read; a row whose ids do not give
    the checksum or the number they were written with ends the read.
    """
    rows = spark.read.schema(_FILE_SQL).orc(f"{folder}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    parts = spark.read.schema("part int, part_tokens long, part_start long").orc(f"{folder}/parts")
    size = 64 * parts.count()
    rows = rows.withColumn("found", ids_crc32("ids")).join(measured(parts.select("part", "part_start"), size), "part")
    intact = (F.col("found") == F.col("ids_crc32")) & (F.size("ids") == F.col("n_tokens"))
    crc = F.when(intact, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("damaged ids of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).alias("ids_crc32")
    return rows.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids", crc)


def token_files(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and read them back; without ``folder`` below the shared one."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, **options)
    return read_tokens(docs.sparkSession, folder)
