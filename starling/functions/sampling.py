"""Bounded samples and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_BUCKETS = 2**31 - 1
# A side is broadcast only when it holds at most this many numbers (16 MB).
BROADCAST_VALUES = 2_000_000


def hash_sample(df: DataFrame, rows: int, key: str = "row_id", seed: int = 42) -> list[Row]:
    """``rows`` rows picked by a hash of their key, the same ones on every run.

    A threshold on the hash thins the rows out inside the scan first, so that
    about twice the wanted rows, and not as many per task, reach the last step.
    """
    n = df.count()
    order = F.xxhash64(key, F.lit(seed))
    share = 2.0 * rows / n if n else 1.0
    while True:
        thinned = df if share >= 1.0 else df.where(F.pmod(order, F.lit(_BUCKETS)) < int(share * _BUCKETS))
        picked = thinned.orderBy(order, key).limit(rows).collect()
        if len(picked) == rows or share >= 1.0:
            return picked
        share *= 4.0


def broadcast_if_small(df: DataFrame, values_per_row: int = 1) -> DataFrame:
    """Mark a side for broadcast after counting it; otherwise leave it to shuffle.

    ``df`` should be a written or cached table, because it is counted here.
    """
    return F.broadcast(df) if df.count() * values_per_row <= BROADCAST_VALUES else df
