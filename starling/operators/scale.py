"""Scalers with the usual population-statistics semantics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions.quantiles import exact_quantiles

SCALER_SCHEMA = "position int, name string, center double, divisor double"


@dataclass(frozen=True)
class Scaler:
    """(x - center) / divisor per column; a constant column gets divisor 1, so 0."""

    columns: tuple[str, ...]
    centers: tuple[float, ...]
    divisors: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.centers, self.divisors)
        })

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.col(c) * F.lit(s) + F.lit(m) for c, m, s in zip(self.columns, self.centers, self.divisors)
        })

    def inverse_point(self, point: Sequence[float]) -> list[float]:
        return [x * s + m for x, m, s in zip(point, self.centers, self.divisors)]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *r) for i, r in enumerate(zip(self.columns, self.centers, self.divisors))]
        return spark.createDataFrame(rows, SCALER_SCHEMA)

    @staticmethod
    def from_frame(frame: DataFrame) -> Scaler:
        rows = frame.orderBy("position").collect()
        return Scaler(
            tuple(r["name"] for r in rows), tuple(r["center"] for r in rows), tuple(r["divisor"] for r in rows)
        )


def _require_values(columns: Sequence[str], found: Sequence[float | None]) -> None:
    empty = [c for c, value in zip(columns, found) if value is None]
    if empty:
        raise ValueError(f"columns without any value cannot be scaled: {empty}")


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str | None = "standard") -> Scaler:
    """Fit in one aggregate; ``None`` or an unknown method leaves the data as it is."""
    columns = list(columns)
    if method == "robust":
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        _require_values(columns, [quartiles[c][0] for c in columns])
        centers = [quartiles[c][1] for c in columns]
        divisors = [quartiles[c][2] - quartiles[c][0] for c in columns]
    elif method in ("standard", "minmax"):
        first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        row = df.agg(
            *[first(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
            *[second(c).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
        ).first()
        centers = list(row[: len(columns)])
        _require_values(columns, centers)
        divisors = list(row[len(columns):])
        if method == "minmax":
            divisors = [high - low for low, high in zip(centers, divisors)]
    else:
        centers, divisors = [0.0] * len(columns), [1.0] * len(columns)
    return Scaler(tuple(columns), tuple(centers), tuple(s if s else 1.0 for s in divisors))
