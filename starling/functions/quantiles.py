"""Exact, linearly interpolated quantiles of columns of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# `percentile` keeps one entry per distinct value in a single buffer, so it is
# used only up to this many rows; more rows are narrowed down first.
BUFFER_ROWS = 1_000_000
BRACKET_ROWS = 100_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffer_rows: int = BUFFER_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles per column, NULLs ignored; all NULL gives None."""
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    result: dict[str, list[float | None]] = {}
    grid = F.array(*[F.lit(p) for p in probabilities])
    for small in _groups([(c, sizes[i]) for i, c in enumerate(columns) if sizes[i] <= buffer_rows], buffer_rows):
        row = df.agg(*[F.percentile(F.col(c).cast("double"), grid).alias(f"q{i}") for i, c in enumerate(small)]).first()
        result.update({c: list(row[i]) if row[i] is not None else [None] * len(probabilities) for i, c in enumerate(small)})
    large = [(c, sizes[i]) for i, c in enumerate(columns) if c not in result]
    if large:
        targets = [_Target(c, n, p) for c, n in large for p in probabilities]
        _narrow(df, targets, min(buffer_rows, BRACKET_ROWS))
        for c, _ in large:
            result[c] = [t.value for t in targets if t.column == c]
    return result


def _groups(sized: list[tuple], most: int) -> list[list]:
    """Runs of items whose sizes add up to ``most`` at most, one item at least."""
    groups, filled = [], 0
    for item, size in sized:
        if not groups or filled + size > most:
            groups.append([])
            filled = 0
        groups[-1].append(item)
        filled += size
    return groups


@dataclass
class _Target:
    """One wanted quantile and the values, bounds excluded, among which its ranks are known to lie."""

    column: str
    rows: int
    probability: float
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    margin: float = 0.002
    value: float | None = None

    def __post_init__(self):
        self.inside = self.rows
        self.position = self.probability * (self.rows - 1)
        self.first = math.floor(self.position)
        self.second = min(self.first + 1, self.rows - 1)

    @property
    def at(self) -> float:
        """Where in the bracket the wanted rank lies, from 0 to 1."""
        return (self.first - self.below) / self.inside

    def values(self) -> Column:
        x = F.col(self.column).cast("double")
        return x if self.low is None else F.when((x > self.low) & (x < self.high), x)

    def decide(self, known: dict[int, float]) -> bool:
        """Take the value if both ranks it lies between are known."""
        if self.first in known and self.second in known:
            low, high = known[self.first], known[self.second]
            self.value = low + (high - low) * (self.position - self.first)
        return self.value is not None


def _narrow(df: DataFrame, targets: list[_Target], buffer_rows: int) -> None:
    """Shrink all brackets together, then read the quantiles out of them.

    A round costs two scans for all columns and quantiles at once: one proposes
    tighter bounds by an approximate percentile, one counts the values below,
    on and between them. Copies of the bounds are set apart, so a heavy value is
    either the answer or gone from the bracket; a proposal that misses the
    wanted ranks is widened. So the result is exact and every round ends nearer.
    """
    while True:
        moving = [t for t in targets if t.value is None and t.inside > buffer_rows]
        if not moving:
            break
        proposals = []
        for t in moving:
            edges = F.array(F.lit(max(t.at - t.margin, 0.0)), F.lit(min(t.at + t.margin, 1.0)))
            proposals += [F.percentile_approx(t.values(), edges, 10_000), F.min(t.values()), F.max(t.values())]
        row = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(proposals)]).first()
        bounds = [
            (
                row[3 * i][0] if t.at - t.margin > 0 else row[3 * i + 1],
                row[3 * i][1] if t.at + t.margin < 1 else row[3 * i + 2],
            )
            for i, t in enumerate(moving)
        ]
        counts = []
        for t, (low, high) in zip(moving, bounds):
            x = t.values()
            between = F.when((x > low) & (x < high), x)
            counts += [F.count_if(x < low), F.count_if(x == low), F.count(between), F.count_if(x == high), F.min(between), F.max(between)]
        row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        for i, (t, (low, high)) in enumerate(zip(moving, bounds)):
            under, on_low, inside, on_high, least, most = row[6 * i : 6 * i + 6]
            start = t.below + under
            middle = start + on_low
            end = middle + inside + (on_high if high > low else 0)
            if not (start <= t.first and t.second < end):
                t.margin *= 4
                continue
            known = {}
            for rank in (t.first, t.second):
                if rank < middle:
                    known[rank] = low
                elif rank >= middle + inside:
                    known[rank] = high
                elif rank in (middle, middle + inside - 1):
                    known[rank] = least if rank == middle else most
            if not t.decide(known):
                t.low, t.high, t.below, t.inside, t.margin = low, high, middle, inside, 0.002
    for group in _groups([(t, t.inside) for t in targets if t.value is None], BUFFER_ROWS):
        row = df.agg(*[
            F.percentile(t.values(), F.lit((t.position - t.below) / max(t.inside - 1, 1))).alias(f"v{i}") for i, t in enumerate(group)
        ]).first()
        for i, t in enumerate(group):
            t.value = row[i]
