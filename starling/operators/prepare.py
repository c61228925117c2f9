"""Column selection, missing values, outliers and feature arrays."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.functions.quantiles import exact_quantiles
from starling.functions.vectors import hash_normal, hash_uniform, l2_normalize

WIDTH = "width"
IMPUTE_STRATEGIES = ("mean", "median", "mode")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns (booleans are not numeric), in table order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as doubles with NaN turned into NULL."""
    columns = numeric_columns(df, exclude)
    if not columns:
        raise ValueError("No numeric columns found in the dataset")
    return df.select(*[missing_as_null(df, c).cast("double").alias(c) for c in columns])


def split_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(numeric features, target column), the target taken out of the features."""
    if target is None or target not in df.columns:
        return select_numeric(df), None
    return select_numeric(df, exclude=[target]), df.select(target)


def missing_as_null(df: DataFrame, column: str) -> Column:
    """The column with NaN read as missing."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(column), None).otherwise(F.col(column))
    return F.col(column)


def to_features(df: DataFrame, columns: Sequence[str], id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature frame ``(row_id, features array<double>, <kept columns>)``.

    A single array column (an embedding) passes through as doubles.
    """
    columns = list(columns)
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.ArrayType):
        features = F.col(columns[0]).cast("array<double>")
    else:
        features = F.array(*[F.col(c).cast("double") for c in columns])
        return df.select(F.col(id_col).alias("row_id"), with_width(features, len(columns)), *keep)
    return df.select(F.col(id_col).alias("row_id"), features.alias("features"), *keep)


def with_width(features: Column, dims: int) -> Column:
    """The ``features`` column with its length noted in the schema."""
    return features.alias("features", metadata={WIDTH: dims})


def width(ff: DataFrame) -> int:
    """Number of features, from the schema if it is noted there, else from one row."""
    noted = ff.schema["features"].metadata.get(WIDTH)
    if noted is not None:
        return noted
    row = ff.select(F.size("features").alias("d")).first()
    if row is None:
        raise ValueError("the feature frame is empty")
    return row["d"]


def impute_values(df: DataFrame, strategy: str, columns: Sequence[str]) -> dict[str, float | str]:
    """Fill value per column. Text columns always take their mode."""
    if strategy not in IMPUTE_STRATEGIES:
        raise ValueError(f"Unknown imputation strategy: {strategy}")
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    clean = df.select(*[missing_as_null(df, c).alias(c) for c in columns])
    fills: dict[str, float | str | None] = {}
    if strategy == "mean" and numeric:
        fills.update(clean.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict())
    elif strategy == "median" and numeric:
        fills.update({c: q[0] for c, q in exact_quantiles(clean, numeric, [0.5]).items()})
    modal = [c for c in columns if c not in fills]
    if modal:
        # All columns are counted in one pass, per value first: a hot value becomes one partial row per task.
        pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("exact")) for i, c in enumerate(modal)])
        counted = clean.select(F.explode(pairs).alias("p")).where(F.col("p.exact").isNotNull()).groupBy("p.c", "p.exact").agg(F.count("*").alias("n"))
        is_number = F.col("c").isin([i for i, c in enumerate(modal) if c in numeric])
        number = F.when(is_number, F.col("exact").try_cast("double"))
        best = counted.groupBy("c").agg(F.min_by("exact", F.struct(-F.col("n"), number, F.col("exact"))).alias("top"))
        tops = {modal[r["c"]]: r["top"] for r in best.collect()}
        for c in modal:
            fills[c] = _typed(tops.get(c), df.schema[c].dataType) if c in tops else (0 if c in numeric else "Unknown")
    return fills


def _typed(text: str, kind: T.DataType) -> float | int | Decimal | str:
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    return float(text) if isinstance(kind, T.NumericType) else text


def impute(df: DataFrame, strategy: str = "mean", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing values; fitted constants go into the projection as literals."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    columns = list(columns)
    fills = impute_values(df, strategy, columns)
    return df.withColumns({
        c: F.coalesce(missing_as_null(df, c), F.lit(fills[c])) for c in columns if fills[c] is not None
    })


def require_complete(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if any value is missing (algorithms cannot take NULL or NaN)."""
    missing = df.agg(*[F.count_if(missing_as_null(df, c).isNull()).alias(c) for c in columns]).first().asDict()
    bad = {c: n for c, n in missing.items() if n}
    if bad:
        raise ValueError(f"missing values present, impute them first: {bad}")


def remove_outliers(
    df: DataFrame,
    method: str = "iqr",
    threshold: float | None = None,
    columns: Sequence[str] | None = None,
    joint: bool = False,
    keep_null: bool = False,
) -> DataFrame:
    """Drop outlying rows column by column.

    Column j's bounds come from the rows that survived the columns before it,
    so each column costs one pass over the source; that pass reads only the
    columns filtered so far, and the bounds are literals that reach the scan.
    ``joint=True`` takes all bounds from the full table in one pass instead.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"Unknown outlier method: {method}")
    threshold = 1.5 if threshold is None else threshold
    columns = numeric_columns(df) if columns is None else list(columns)
    kept = df
    joint_bounds = _bounds(df, columns, method, threshold) if joint else {}
    for c in columns:
        low, high = joint_bounds[c] if joint else _bounds(kept, [c], method, threshold)[c]
        # NaN compares above every number, so the plain column already drops it
        # and the range reaches the scan.
        value = missing_as_null(df, c) if keep_null else F.col(c)
        if low is None:
            inside = F.lit(False)
        elif method == "iqr":
            inside = (value >= low) & (value <= high)
        elif high:
            reach = threshold * high * (1 + 1e-9)
            inside = (value >= low - reach) & (value <= low + reach) & (F.abs((value - low) / high) < threshold)
        else:
            inside = F.lit(False)
        kept = kept.where((inside | value.isNull()) if keep_null else inside)
    return kept


def _bounds(df, columns, method, threshold):
    clean = df.select(*[missing_as_null(df, c).alias(c) for c in columns])
    if method == "iqr":
        quartiles = exact_quantiles(clean, columns, [0.25, 0.75])
        return {
            c: (None, None) if q1 is None else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
            for c, (q1, q3) in quartiles.items()
        }
    row = clean.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def outlier_report(df: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows before, rows removed, percent removed."""
    zero = F.lit(0).cast("long")
    before = df.agg(F.count("*").alias("n_rows")).select("n_rows", zero.alias("n_kept"))
    after = kept.agg(F.count("*").alias("n_kept")).select(zero.alias("n_rows"), "n_kept")
    totals = before.unionByName(after).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_kept").alias("n_kept"))
    removed = F.col("n_rows") - F.col("n_kept")
    return totals.select(
        "n_rows",
        removed.alias("removed"),
        F.when(F.col("n_rows") > 0, removed * 100.0 / F.col("n_rows")).otherwise(0.0).alias("removed_percent"),
    )


def augment(ff: DataFrame, noise: float = 0.1, dropout: float = 0.1, seed: int = 42) -> DataFrame:
    """Two views per row: Gaussian noise added, and features dropped to 0.

    The random numbers hang on (row_id, position), not on the partitioning.
    """
    key = F.col("row_id")
    noisy = F.transform("features", lambda x, j: x + F.lit(noise) * hash_normal(seed, key, j))
    dropped = F.transform(
        "features", lambda x, j: F.when(hash_uniform(seed + 1, key, j) < dropout, 0.0).otherwise(x)
    )
    return ff.withColumns({"view_noise": noisy, "view_dropout": dropped})


def normalize_rows(ff: DataFrame) -> DataFrame:
    """Rows scaled to unit length."""
    return ff.withColumn("features", l2_normalize(F.col("features")))
