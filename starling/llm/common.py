"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A join side of at most this many bytes, measured before, is broadcast.
BROADCAST_BYTES = 32 << 20


# Rows of an Arrow batch: whole texts are long rows, and a batch is held several times over.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays."""
    now = int(spark.conf.get(_BATCH_SETTING))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in a session with short batches."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(side: DataFrame, n_bytes: int | None) -> DataFrame:
    """``side`` with a broadcast hint if its measured size allows it.

    A larger side is left as it is, so the join shuffles and adaptive
    execution splits its heavy keys.
    """
    return F.broadcast(side) if (n_bytes or 0) <= BROADCAST_BYTES else side


def record_batches(rows: Callable[[pa.RecordBatch], Iterator | list], schema: pa.Schema):
    """A ``mapInArrow`` function from one that turns a batch into column lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = rows(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema
            )

    return run


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def has_repeats(ids: DataFrame, column: str) -> bool:
    """Whether an id occurs twice or is null; only the ids are shuffled."""
    counted = ids.groupBy(column).agg(F.count("*").alias("n"))
    return counted.where((F.col("n") > 1) | F.col(column).isNull()).limit(1).count() > 0
