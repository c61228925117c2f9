"""K-means rounds over packs of neighbouring rows.

A pack holds 16 nodes of 16 cells of 16 rows, split like a k-d tree. A round
sends the centres down the tree (the filtering of Kanungo et al., 2002): where
one centre is nearest to a whole box, the box's sums are added at once, and rows
are compared only where cells lie between centres. What a box rules out is ruled
out exactly, so every row goes to the centre that it would go to by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.sampling import hash_sample
from starling.functions.space import planes

FAN = 16
PACK = FAN**3
# Rows per task, and rows that are split into packs in one go.
TASK_ROWS, PACKED_AT_ONCE = 400_000, 64 * PACK
SAMPLE_ROWS = 20_000
# Centres that meet packs in one go, and boxes whose children are measured in one go, so that they stay in a core's cache.
PAIRS, ITEMS = 4096, 1024
# Packs that are looked into together, and numbers of centres by which cells are grouped.
TOGETHER, WIDTHS = 8, (2, 3, 4, 6, 9, 14)
# Boxes are told apart with this much room, relative to squared lengths: more than rounding can add up to.
ROOM = 1e-12


def packed(data: DataFrame, n: int, middle: np.ndarray) -> tuple[DataFrame, int]:
    """``(values, rows)`` per pack, its values less ``middle`` and by column, and the number of tasks.

    Planes from a sample deal the rows out, so that a task holds neighbours; parts
    with many rows, which are copies for the most part, are dealt over several tasks.
    """
    cores = data.sparkSession.sparkContext.defaultParallelism
    dims = len(middle)
    depth = math.ceil(math.log2(max(n / TASK_ROWS, min(2 * cores, n / PACK), 1)))
    sample = np.array([r["features"] for r in hash_sample(data, SAMPLE_ROWS)], dtype=float)
    tree = planes(sample, depth)
    shares = np.bincount(tree.leaf(sample), minlength=2**depth) / len(sample)
    parts = np.maximum(1, np.round(shares * 2**depth / 2)).astype(int)
    first = np.cumsum(parts) - parts
    tasks = int(parts.sum())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            leaf, salt = tree.leaf(x), batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((first[leaf] + salt % parts[leaf]).astype("int32"))], ["features", "task"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) - middle)
            if sum(map(len, held)) >= PACKED_AT_ONCE:
                yield from _packs(np.vstack(held))
                held = []
        if held:
            yield from _packs(np.vstack(held))

    salted = data.select("features", F.pmod(F.xxhash64("row_id"), F.lit(1 << 20)).alias("salt"))
    dealt = salted.mapInArrow(place, "features array<double>, task int").repartitionById(tasks, F.col("task"))
    return dealt.select("features").mapInArrow(pack, "values binary, rows int"), tasks


def _packs(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in packs, each split at the middle of its longest side down to cells."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        low, high = todo.pop()
        unit = next((u for u in (PACK, FAN * FAN, FAN) if high - low > u), 0)
        if not unit:
            continue
        part = x[order[low:high]]
        column = part[:, (part.max(axis=0) - part.min(axis=0)).argmax()]
        half = math.ceil((high - low) / unit) // 2 * unit
        order[low:high] = order[low:high][np.argpartition(column, half)]
        todo += [(low, low + half), (low + half, high)]
    x = x[order]
    for at in range(0, len(x), PACK):
        part = x[at : at + PACK]
        # Missing rows of the last pack are copies that count nothing.
        full = np.vstack([part, np.repeat(part[-1:], PACK - len(part), axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(full.T).tobytes()], pa.binary()), pa.array([len(part)], pa.int32())], ["values", "rows"])


class Tally:
    """Sums, counts and costs of the rows nearest to each of the stacked centres."""

    def __init__(self, stacked: np.ndarray, ends: np.ndarray):
        self.z, self.norm = np.ascontiguousarray(stacked.T), (stacked**2).sum(axis=1)
        self.counts, self.dims = np.diff(ends, prepend=0), stacked.shape[1]
        self.at_root = max(1, PAIRS // len(stacked))
        self.together = max(TOGETHER, self.at_root)
        self.open: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.table = np.zeros((self.dims + 2, len(stacked)))
        self.notes: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        values, rows = batch.column(0), batch.column(1).to_numpy()
        for at in range(0, len(rows), self.together):
            some = [np.frombuffer(values[i].as_buffer(), dtype=float) for i in range(at, min(at + self.together, len(rows)))]
            self._measure(np.stack(some).reshape(len(some), self.dims, PACK).transpose(1, 0, 2), rows[at : at + len(some)])
            for first in range(0, len(some), self.at_root):
                self._root(first, min(first + self.at_root, len(some)))
            for level, descend in ((1, self._boxes), (2, self._rows)):
                open_, self.open = self.open, {}
                for groups in open_.values():
                    node, centre = np.concatenate([n for n, _ in groups]), np.concatenate([c for _, c in groups], axis=1)
                    for cut in range(0, len(node), ITEMS):
                        descend(node[cut : cut + ITEMS], centre[:, cut : cut + ITEMS])
            self._settle()

    def _measure(self, x: np.ndarray, rows: np.ndarray) -> None:
        """Counts, sums, squares about the mean and means of cells and nodes, and their boxes; children are the first axis."""
        cells = len(rows) * FAN * FAN
        x = x.reshape(self.dims, cells, FAN)
        real = (np.arange(PACK) < rows[:, None]).reshape(cells, FAN)
        n, low, high = real.sum(axis=1).astype(float), x.min(axis=2), x.max(axis=2)
        sums = (x * real).sum(axis=2)
        mean = np.clip(sums / np.maximum(n, 1), low, high)
        squares = (((x - mean[:, :, None]) ** 2).sum(axis=0) * real).sum(axis=1)
        fold = lambda a: a.reshape(*a.shape[:-1], -1, FAN)
        turn = lambda a: np.ascontiguousarray(np.swapaxes(fold(a), -1, -2))
        node_n, node_low, node_high = fold(n).sum(axis=1), fold(low).min(axis=2), fold(high).max(axis=2)
        node_sums = fold(sums).sum(axis=2)
        node_mean = np.clip(node_sums / np.maximum(node_n, 1), node_low, node_high)
        node_squares = (fold(squares) + ((fold(mean) - node_mean[:, :, None]) ** 2).sum(axis=0) * fold(n)).sum(axis=1)
        self.stats = [np.vstack([node_sums, node_n, node_squares, node_mean]), np.vstack([sums, n, squares, mean])]
        self.place = [turn((node_low + node_high) / 2), turn((low + high) / 2), np.ascontiguousarray(np.swapaxes(x, 1, 2))]
        self.half = [turn((node_high - node_low) / 2), turn((high - low) / 2)]
        self.filled = None if real.all() else [turn(node_n > 0), turn(n > 0), np.ascontiguousarray(real.T)]
        self.bounds = node_low.reshape(self.dims, -1, FAN).min(axis=2), node_high.reshape(self.dims, -1, FAN).max(axis=2)
        self.room = ROOM * (self.norm.max() + (np.maximum(low**2, high**2)).sum(axis=0).max())

    def _root(self, first: int, end: int) -> None:
        """All centres against each pack, and those that may be nearest in it against its nodes."""
        packs = end - first
        counts = np.tile(self.counts, packs)
        centre = np.tile(np.arange(len(self.norm)), packs)
        starts, node = np.cumsum(counts) - counts, np.repeat(np.arange(first, end), len(self.counts))
        item = np.repeat(np.arange(len(counts)), counts)
        low, high = self.bounds
        lo, hi = low[:, node], high[:, node]
        middle, half = ((lo + hi) / 2)[:, item], ((hi - lo) / 2)[:, item]
        z = self.z[:, centre]
        close = self.norm[centre] - 2.0 * (z * middle).sum(axis=0)
        least = np.minimum.reduceat(close, starts)
        own = np.minimum.reduceat(np.where(close == least[item], np.arange(len(centre)), len(centre)), starts)
        reach = 2.0 * (half * np.abs(z - z[:, own[item]])).sum(axis=0) + self.room
        near = close - least[item] <= reach
        counts = np.add.reduceat(near.astype(int), starts)
        centre, item, starts = centre[near], item[near], np.cumsum(counts) - counts
        place, half = (a[0][:, :, node[item]] for a in (self.place, self.half))
        close = np.repeat(self.norm[centre][None, :], FAN, axis=0)
        for j in range(self.dims):
            close -= 2.0 * self.z[j][centre] * place[j]
        least = np.minimum.reduceat(close, starts, axis=1)
        nearest = np.where(close == least[:, item], np.arange(len(centre)), len(centre))
        own = centre[np.minimum.reduceat(nearest, starts, axis=1)]
        reach = np.full(close.shape, self.room)
        for j in range(self.dims):
            reach += 2.0 * half[j] * np.abs(self.z[j][centre] - self.z[j][own][:, item])
        near = close - least[:, item] <= reach
        left = np.add.reduceat(near.astype(int), starts, axis=1)
        if self.filled is not None:
            left[~self.filled[0][:, node]] = 0
        child, at = np.nonzero(left == 1)
        self._won(0, node[at] * FAN + child, own[child, at])
        for count in np.unique(left[left > 1]):
            child, at = np.nonzero(left == count)
            open_ = np.zeros(left.shape, dtype=bool)
            open_[child, at] = True
            child_of, pair = np.nonzero(near & open_[:, item])
            self._put(node[at] * FAN + child, centre[pair].reshape(-1, count).T)

    def _put(self, box: np.ndarray, centre: np.ndarray) -> None:
        """Boxes to look into, each with the centres of a run, ascending, that may be nearest to some of their rows."""
        self.open.setdefault(len(centre), []).append((box, centre))

    def _gaps(self, place: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
        """How much farther each but the first centre is than the first, in squares."""
        gaps, z = [], self.z[:, centre]
        for q in range(1, len(centre)):
            slope = -2.0 * (z[:, q] - z[:, 0])
            gap = place[0] * slope[0]
            for j in range(1, self.dims):
                gap += place[j] * slope[j]
            gap += self.norm[centre[q]] - self.norm[centre[0]]
            gaps.append(gap)
        return gaps

    def _boxes(self, node: np.ndarray, centre: np.ndarray) -> None:
        place, half = ([np.take(a[1][j], node, axis=1) for j in range(self.dims)] for a in (self.place, self.half))
        gaps = self._gaps(place, centre)
        filled = None if self.filled is None else self.filled[1][:, node]
        if len(centre) == 2:
            gap, slope = gaps[0], 2.0 * np.abs(self.z[:, centre[1]] - self.z[:, centre[0]])
            reach = half[0] * slope[0]
            for j in range(1, self.dims):
                reach += half[j] * slope[j]
            reach += self.room
            between = np.abs(gap) <= reach
            won = ~between
            if filled is not None:
                between &= filled
                won &= filled
            child, at = np.nonzero(won)
            self._won(1, node[at] * FAN + child, np.where(gap[child, at] > 0, centre[0][at], centre[1][at]))
            child, at = np.nonzero(between)
            self._put(node[at] * FAN + child, centre[:, at])
            return
        least, own = np.zeros(gaps[0].shape), np.zeros(gaps[0].shape, dtype=int)
        for q, gap in enumerate(gaps, 1):
            own[gap < least] = q
            np.minimum(least, gap, out=least)
        own = centre[own, np.arange(len(node))]
        here = [self.z[j][own] for j in range(self.dims)]
        near = np.empty((len(centre), *own.shape), dtype=bool)
        for q in range(len(centre)):
            reach = np.full(own.shape, self.room)
            for j in range(self.dims):
                apart = here[j] - self.z[j][centre[q]]
                np.abs(apart, out=apart)
                apart *= half[j]
                reach += apart
                reach += apart
            near[q] = (gaps[q - 1] if q else 0.0) - least <= reach
        left = near.sum(axis=0)
        if filled is not None:
            left[~filled] = 0
        child, at = np.nonzero(left == 1)
        self._won(1, node[at] * FAN + child, own[child, at])
        for count in range(2, len(centre) + 1):
            child, at = np.nonzero(left == count)
            if len(at):
                of = centre.T[at][near[:, child, at].T].reshape(-1, count).T
                # A centre that comes again wins nothing: few widths make long groups.
                more = next((w for w in WIDTHS if w >= count), count) - count
                self._put(node[at] * FAN + child, np.vstack([of, np.repeat(of[-1:], more, axis=0)]))

    def _rows(self, node: np.ndarray, centre: np.ndarray) -> None:
        x = [np.take(self.place[2][j], node, axis=1) for j in range(self.dims)]
        gaps = self._gaps(x, centre)
        least = np.minimum(gaps[0], 0.0)
        for gap in gaps[1:]:
            np.minimum(least, gap, out=least)
        if self.filled is not None:
            least[~self.filled[2][:, node]] = 0.0
        # All rows of the cell for the first centre, less those that are nearer to another.
        first = self._won(1, node, centre[0])
        first[self.dims + 1] += least.sum(axis=0)
        free = least < 0
        for q, gap in enumerate(gaps, 1):
            later = free
            if len(gaps) > 1:  # ties go to the lowest centre
                later = free & (gap == least)
                free ^= later
            moved, later = np.zeros(first.shape), later.astype(float)
            for j in range(self.dims):
                np.einsum("ri,ri->i", later, x[j], out=moved[j])
            moved[self.dims] = later.sum(axis=0)
            first -= moved
            self._note(centre[q], moved)

    def _won(self, level: int, box: np.ndarray, centre: np.ndarray) -> np.ndarray:
        stats = self.stats[level][:, box]
        gaps = np.zeros(len(box))
        for j in range(self.dims):
            gap = stats[self.dims + 2 + j] - self.z[j][centre]
            gaps += gap * gap
        gained = stats[: self.dims + 2]
        gained[self.dims + 1] += gained[self.dims] * gaps
        self._note(centre, gained)
        return gained

    def _note(self, centre: np.ndarray, values: np.ndarray) -> None:
        self.notes.append((centre, values))

    def _settle(self) -> None:
        centre, values = np.concatenate([c for c, _ in self.notes]), np.concatenate([v for _, v in self.notes], axis=1)
        for line, value in zip(self.table, values):
            line += np.bincount(centre, value, len(line))
        self.notes = []
