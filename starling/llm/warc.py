"""WARC archives compressed with Zstandard: a dictionary frame, then one frame for each record.

Writing: payloads that occur more than once are stored once, the other records
revisit it. Each task turns its rows into frames and Spark's text writer lays
them down as files in any store it can write; the writer's line end after each
frame is the content of a one-byte skippable frame, so the files are plain
``.warc.zst``. Reading takes the dictionary from the leading skippable frame,
decodes one frame per record, and checks versions, headers, lengths and ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.llm.common import measured, utf8
from starling.session import cut_lineage, scratch_path

# Frame magics of the Zstandard format, the dictionary frame of WARC archives, and a dictionary's own magic.
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE_LOW, SKIPPABLE_HIGH = 0x184D2A50, 0x184D2A5F
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_FORM = "<urn:starling:page:%s>"
# Payloads shorter than this are never replaced by a revisit.
MIN_REVISIT_BYTES = 1000
# The dictionary is trained on at most so many pages of at most so many bytes each; it does not change what is read back.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 20_000, 32_768
# Lines of an archive file, and frame bytes after which empty frames fill its lines up, so that the next file begins.
ARCHIVE_ROWS = 4000
ARCHIVE_BYTES = 64 << 20
_LINE_FRAME = struct.pack("<II", SKIPPABLE_LOW, 1)
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """A record or frame that breaks the format."""


# ------------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record's bytes; header values must not hold line ends."""
    lines = [VERSION]
    for name, value in {**headers, "Content-Length": str(len(block))}.items():
        if re.search(r"[\r\n]", value):
            raise WarcError(f"line end in header {name}")
        lines.append(utf8(f"{name}: {value}"))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of exactly one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("headers do not end")
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("not a WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise WarcError("malformed header line")
        headers[name.decode().lower()] = value.strip(b" \t").decode("utf-8", "surrogateescape")
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise WarcError(f"missing {missing[0]}")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise WarcError("Content-Length is not a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4:
        raise WarcError("block length differs from Content-Length")
    if rest[length:] != b"\r\n\r\n":
        raise WarcError("record does not end with two line ends")
    return headers, rest[:length]


def parse_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"HTTP/"):
        raise WarcError("not an HTTP response")
    pairs = (line.partition(b":") for line in lines[1:])
    return {n.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for n, _, v in pairs}, body


# -------------------------------------------------------------------- frames


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def load_dictionary(data: bytes) -> tuple[bytes | None, int]:
    """The dictionary in a leading skippable frame, packed or not, and where records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    content = data[8 : 8 + size]
    if len(content) != size:
        raise WarcError("dictionary frame is cut short")
    if size >= 4 and struct.unpack_from("<I", content)[0] == ZSTD_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
        raise WarcError("leading frame holds no dictionary")
    return content, 8 + size


def read_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record's frame; other skippable frames are passed over."""
    dictionary, at = load_dictionary(data)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decoder = zstandard.ZstdDecompressor(**options)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError(f"frame at {at} is cut short")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
            if at + 8 + size > len(data):
                raise WarcError(f"skippable frame at {at} is cut short")
            at += 8 + size
            continue
        if magic != ZSTD_MAGIC:
            raise WarcError(f"no frame at {at}")
        parts, fed, one = [], at, decoder.decompressobj()
        try:
            while not one.eof and fed < len(data):
                piece = view[fed : fed + (1 << 16)]
                parts.append(one.decompress(piece))
                fed += len(piece)
        except zstandard.ZstdError as error:
            raise WarcError(f"frame at {at}: {error}") from error
        if not one.eof:
            raise WarcError(f"frame at {at} is cut short")
        yield at, b"".join(parts)
        at = fed - len(one.unused_data)


@dataclass
class Frames:
    """Writes frames of one archive with its dictionary."""

    dictionary: bytes | None
    level: int = 3
    _packer: zstandard.ZstdCompressor = field(init=False, repr=False)

    def __post_init__(self) -> None:
        options = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
        self._packer = zstandard.ZstdCompressor(level=self.level, write_content_size=True, write_checksum=True, **options)

    def opening(self) -> bytes:
        return dictionary_frame(self.dictionary) + _LINE_FRAME if self.dictionary else _LINE_FRAME

    def frame(self, raw: bytes) -> bytes:
        return self._packer.compress(raw) + _LINE_FRAME


def train_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes | None:
    """A dictionary from the pages with the smallest hashes of their id; None if they are too few or too alike."""
    order = F.xxhash64(F.lit("dictionary"), id_col)
    hashes = pages.where(F.length(html_col) > 0).select(order.alias("o"))
    last = hashes.orderBy("o").limit(SAMPLE_PAGES).agg(F.max("o")).first()[0]
    sample = pages.where((F.length(html_col) > 0) & (order <= F.lit(last))).select(F.substring(html_col, 1, SAMPLE_BYTES).alias("s"))
    texts = sorted(utf8(r["s"]) for r in sample.limit(SAMPLE_PAGES).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) > 7 else None
    except zstandard.ZstdError:
        return None


# ------------------------------------------------------------ Spark reading and writing


def _page_record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit without payload whose HTTP header still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": ID_FORM % page_id, "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers |= {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": payload_digest(payload)}
    if refers_to:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": ID_FORM % refers_to}
    return record(headers, http if refers_to else http + payload)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` below ``path``, each file a ``.warc.zst``.

    The payload is the html in UTF-8, null as empty. Of equal payloads of
    ``MIN_REVISIT_BYTES`` or more the record with the largest id is a response
    and records with smaller or null ids revisit it; repeated rows with that id
    are all responses. A group of null ids alone has only responses. A null url
    leaves the header out. Other columns are not looked at. Files hold about
    ``archive_bytes`` at most, and one record at least.
    """
    digest = F.sha1(F.coalesce(F.col(html_col), F.lit("")))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    large = plain.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select(F.sha1("html").alias("digest"), "id")
    groups = cut_lineage(large.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("keeper").isNotNull()).drop("n"))
    groups = measured(groups, 96 * groups.count())
    rows = plain.withColumn("own", F.when(F.octet_length("html") >= MIN_REVISIT_BYTES, digest)).join(groups, F.col("own") == F.col("digest"), "left")
    rows = rows.select(F.col("id").cast("string"), "url", "html", F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).cast("string").alias("keeper"))
    dictionary = train_dictionary(pages, id_col, html_col)
    schema = pa.schema([("frame", pa.binary())])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Frames(dictionary)
        lines = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = []
                for page_id, url, html, keeper in zip(*(c.to_pylist() for c in part.columns)):
                    if not lines:
                        out.append(writer.opening())
                        lines, size = 1, 0
                    out.append(writer.frame(_page_record("" if page_id is None else page_id, url, utf8(html), keeper, date)))
                    lines, size = lines + 1, size + len(out[-1])
                    if size >= archive_bytes:
                        out += [_LINE_FRAME] * (ARCHIVE_ROWS - lines)
                        lines = ARCHIVE_ROWS
                    if lines == ARCHIVE_ROWS:
                        lines = 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)

    lines = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", ARCHIVE_ROWS).option("compression", "none").text(path)


RECORD_SCHEMA = "file string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, with ``error`` null, or one for each bad record or file.

    A bad record is told and the next frame read; a bad frame ends its file. The
    digest is that of the full payload, in lower-case hex: computed and compared
    with the header for responses, taken from the header for revisits, whose
    payload is null and whose payload length comes from the HTTP header.
    """
    names = ["file", "offset", "warc_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]

    def row(file: str, offset: int, raw: bytes) -> tuple:
        headers, block = parse_record(raw)
        kind, payload = headers["warc-type"], None
        stated = headers.get("warc-payload-digest", "")
        digest = base64.b32decode(stated[5:]).hex() if stated.startswith("sha1:") else None
        size = None
        if kind in ("response", "revisit"):
            http, body = parse_http(block)
            size = int(http.get("content-length", len(body)))
            if kind == "response":
                payload, own = body, hashlib.sha1(body).hexdigest()
                if len(body) != size:
                    raise WarcError("payload length differs from the HTTP header")
                if digest not in (None, own):
                    raise WarcError("payload digest differs")
                digest = own
        return (file, offset, kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-refers-to"), size, digest, payload, None)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                out, offset = [], 0
                try:
                    for offset, raw in read_frames(content):
                        try:
                            out.append(row(file, offset, raw))
                        except ValueError as error:
                            out.append((file, offset, *[None] * 7, str(error)))
                        if len(out) >= 200:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except WarcError as error:
                    out.append((file, offset, *[None] * 7, str(error)))
                yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(records, RECORD_SCHEMA)


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, error)``."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"page:(-?\d*)>", 1), F.lit("")).cast("long")
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), "error"
    )
