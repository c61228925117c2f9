"""All-against-all reductions over bounded blocks.

For measures that need every pair of rows. Rows are packed into hash blocks of
bounded size, each pair of blocks is one unit of work for numpy, and only the
reduced result leaves the task; the pairs themselves are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
MAX_TASKS = 20_000
# Blocks a long table is cut into, and numbers in a block at most: every row is copied once per block of the other side.
FEW_BLOCKS, BLOCK_VALUES = 32, 4_000_000

Block = dict[str, np.ndarray]


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    reduce_pair: Callable[[Block, Block], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``reduce_pair(left block, right block)`` to every pair of blocks.

    Both frames need a unique ``row_id`` and an array column ``features``; all
    other columns must be numeric and without NULLs.
    """
    n_left = max(1, math.ceil(left.count() / block_rows))
    n_right = max(1, math.ceil(right.count() / block_rows))
    names = {"l": left.columns, "r": right.columns}
    tasks = min(n_left * n_right, MAX_TASKS)
    lefts = _pack(left, "l", n_left).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    rights = _pack(right, "r", n_right).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    # An explicit count keeps one task per pair; sized by bytes, the few packed
    # bytes would be merged into too few tasks for the arithmetic they carry.
    paired = lefts.repartition(tasks, "l", "r").join(rights.repartition(tasks, "l", "r"), ["l", "r"])

    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                yield reduce_pair(_unpack(row, "l", names["l"]), _unpack(row, "r", names["r"]))

    return paired.mapInPandas(run, schema)


def large_blocks(rows: int, width: int) -> int:
    """Rows per block that keep the copies in proportion to the rows; for reductions that work tile by tile."""
    return max(BLOCK_ROWS, min(math.ceil(rows / FEW_BLOCKS), BLOCK_VALUES // max(width, 1)))


def _pack(df: DataFrame, side: str, blocks: int) -> DataFrame:
    packed = df.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias(side)).agg(
        F.collect_list(F.struct(*df.columns)).alias("_rows")
    )
    fields = [
        (F.flatten(F.col("_rows.features")) if c == "features" else F.col(f"_rows.{c}")).alias(f"{side}_{c}")
        for c in df.columns
    ]
    return packed.select(side, *fields)


def _unpack(row: pd.Series, side: str, names: list[str]) -> Block:
    block = {c: np.asarray(row[f"{side}_{c}"]) for c in names}
    block["features"] = block["features"].reshape(len(block["row_id"]), -1)
    return block


def distances(left: np.ndarray, right: np.ndarray, squared: bool = False) -> np.ndarray:
    """Euclidean distances by direct differences (no cancellation)."""
    out = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        gap = left[:, j, None] - right[None, :, j]
        out += gap * gap
    return out if squared else np.sqrt(out)
