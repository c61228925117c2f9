"""Column expressions over ``array<double>`` features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(terms: Sequence[Column]) -> Column:
    """Sum of columns, left to right."""
    return reduce(lambda left, right: left + right, terms)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda x, y: x * y))


def squared_distance(left: Column, right: Column) -> Column:
    """Squared Euclidean distance of two array columns of any length."""
    return array_sum(F.zip_with(left, right, lambda x, y: (x - y) * (x - y)))


def squared_distance_dims(left: Column, right: Column, dims: int) -> Column:
    """Squared distance; spelled out per dimension while that stays compilable."""
    if dims > 32:
        return squared_distance(left, right)
    return total([(left[j] - right[j]) * (left[j] - right[j]) for j in range(dims)])


def squared_distance_to(features: Column, point: Sequence[float]) -> Column:
    """Squared distance to a fixed point, spelled out so it compiles to plain code."""
    terms = [(features[j] - F.lit(float(c))) * (features[j] - F.lit(float(c))) for j, c in enumerate(point)]
    return total(terms)


def l2_normalize(features: Column) -> Column:
    """Row scaled to unit length; a zero row stays zero."""
    norm = F.sqrt(dot(features, features))
    return F.when(norm == 0.0, features).otherwise(F.transform(features, lambda x: x / norm))


def row_summary(values: Column) -> list[Column]:
    """mean, std (population), min, max and interpolated median of an array row."""
    n = F.size(values)
    mean = array_sum(values) / n
    # Computed once per row: inside a lambda an expression is evaluated for every element.
    once = lambda value, body: F.transform(F.array(value), body)[0]
    variance = once(mean, lambda m: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))) / n
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2 + 1).cast("int")
    middle = once(F.array_sort(values), lambda o: (F.element_at(o, low) + F.element_at(o, high)) / 2)
    return [
        mean.alias("mean"),
        F.sqrt(variance).alias("std"),
        F.array_min(values).alias("min"),
        F.array_max(values).alias("max"),
        middle.alias("median"),
    ]


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Uniform number in (0, 1) that depends on the keys and the seed only.

    Built on md5 of the keys' text, so a row gets the same number under any
    partitioning and after any retry.
    """
    text = F.concat_ws("|", *[key.cast("string") for key in keys], F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (head + F.lit(0.5)) / F.lit(4294967296.0)


def hash_normal(seed: int, *keys: Column) -> Column:
    """Standard normal number per key (Box-Muller over two hash uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(hash_uniform(seed, *keys, F.lit("a"))))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(seed, *keys, F.lit("b")))
