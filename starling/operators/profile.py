"""Data-quality tables: missing values, types, describe, preview, shape."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.quantiles import exact_quantiles
from starling.operators.prepare import missing_as_null, numeric_columns


def inspect(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_numeric, columns, numeric_columns."""
    numeric = numeric_columns(df)
    if not numeric:
        raise ValueError("No numeric columns found in the data")
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(len(numeric)).cast("long").alias("n_numeric"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array(*[F.lit(c) for c in numeric]).alias("numeric_columns"),
    )


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent per column, most first, ties in table order."""
    columns = list(df.columns if columns is None else columns)
    counts = df.agg(
        F.count("*").alias("_n"), *[F.count_if(missing_as_null(df, c).isNull()).alias(c) for c in columns]
    )
    stacked = counts.select(
        "_n",
        F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in columns])),
    )
    return (
        stacked.select(
            F.col("pos").alias("position"),
            F.col("col.name").alias("column_name"),
            F.col("col.n").alias("missing_count"),
            F.when(F.col("_n") > 0, F.col("col.n") * 100.0 / F.col("_n")).otherwise(0.0).alias("missing_percent"),
        )
        .orderBy(F.desc("missing_count"), "position")
        .drop("position")
    )


def type_histogram(df: DataFrame) -> DataFrame:
    """Number of columns per data type, from the schema alone."""
    counts = Counter(f.dataType.simpleString() for f in df.schema)
    return df.sparkSession.createDataFrame(counts.most_common(), "data_type string, n_columns int")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, interpolated quartiles, max per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    clean = df.select(*[missing_as_null(df, c).cast("double").alias(c) for c in columns])
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = clean.agg(*[
        fn(F.col(f"`{c}`")).alias(f"{name}{i}") for i, c in enumerate(columns) for name, fn in measures.items()
    ]).first()
    quartiles = exact_quantiles(clean, columns, [0.25, 0.5, 0.75])
    rows = [
        (c, row[f"count{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], *quartiles[c], row[f"max{i}"])
        for i, c in enumerate(columns)
    ]
    schema = "column_name string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def preview(df: DataFrame, order: Sequence[str], rows: int = 100, columns: int = 5, chars: int = 10) -> DataFrame:
    """First rows and columns as text, long cells cut to ``chars`` plus '...'."""
    shown = df.columns[:columns]

    def cell(c):
        text = F.col(f"`{c}`").cast("string")
        return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text).alias(c)

    return df.orderBy(*order).limit(rows).select(*[cell(c) for c in shown])
