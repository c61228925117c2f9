"""Compressed sets of text offsets: array, bitmap and run containers over blocks of 65536."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

BLOCK_BITS = 16
BITMAP_WORDS = 1024
ARRAY_LIMIT = 4096


class ArrayContainer:
    """Up to ``ARRAY_LIMIT`` low halves, sorted, two bytes each."""

    def __init__(self, lows: np.ndarray):
        self.lows = lows.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.lows[i])

    def rank(self, low: int) -> int:
        return int(np.searchsorted(self.lows, low, side="right"))

    @property
    def nbytes(self) -> int:
        return self.lows.nbytes


class BitmapContainer:
    """One bit per low half, with the number of bits before each word."""

    def __init__(self, lows: np.ndarray):
        bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        bits[lows] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)

    def _low_bits(self, word: int) -> np.ndarray:
        return np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        return word * 64 + int(np.flatnonzero(self._low_bits(word))[i - int(self.before[word])])

    def rank(self, low: int) -> int:
        word = low // 64
        return int(self.before[word]) + int(self._low_bits(word)[: low % 64 + 1].sum())

    @property
    def nbytes(self) -> int:
        return self.words.nbytes


class RunContainer:
    """Stretches of consecutive low halves, as first member and the members before."""

    def __init__(self, lows: np.ndarray):
        breaks = np.flatnonzero(np.diff(lows) != 1) + 1
        heads = np.concatenate([[0], breaks])
        self.starts = lows[heads].astype(np.uint16)
        self.before = np.concatenate([heads, [len(lows)]]).astype(np.uint32)

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])

    def rank(self, low: int) -> int:
        run = int(np.searchsorted(self.starts, low, side="right")) - 1
        if run < 0:
            return 0
        return min(int(self.before[run]) + low - int(self.starts[run]) + 1, int(self.before[run + 1]))

    @property
    def nbytes(self) -> int:
        return self.starts.nbytes + 2 * len(self.starts)


def _container(lows: np.ndarray):
    """The smallest container that holds ``lows``."""
    n_runs = 1 + int(np.count_nonzero(np.diff(lows) != 1))
    plain = 2 * len(lows) if len(lows) <= ARRAY_LIMIT else 8 * BITMAP_WORDS
    if 4 * n_runs < plain:
        return RunContainer(lows)
    return ArrayContainer(lows) if len(lows) <= ARRAY_LIMIT else BitmapContainer(lows)


class BoundarySet:
    """A set of offsets with rank and select.

    Offsets are dealt over blocks by their high bits; each block keeps the
    container that is smallest for it, and ``before`` counts the members of all
    earlier blocks. ``select`` finds the block in ``before`` and the member
    inside its container.
    """

    def __init__(self, offsets):
        offsets = np.asarray(offsets, dtype=np.int64)
        highs = offsets >> BLOCK_BITS
        heads = np.flatnonzero(np.concatenate([[True], highs[1:] != highs[:-1]])) if len(offsets) else np.zeros(0, dtype=np.int64)
        self.keys = highs[heads].tolist()
        self.before = [*heads.tolist(), len(offsets)]
        lows = offsets & ((1 << BLOCK_BITS) - 1)
        self.containers = [_container(lows[a:b]) for a, b in zip(self.before, self.before[1:])]

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, i: int) -> int:
        """The member that has ``i`` smaller ones."""
        if not 0 <= i < len(self):
            raise IndexError(f"rank {i} of {len(self)} members")
        block = bisect_right(self.before, i) - 1
        return (self.keys[block] << BLOCK_BITS) + self.containers[block].select(i - self.before[block])

    def rank(self, offset: int) -> int:
        """Members up to ``offset``, itself included."""
        block = bisect_right(self.keys, offset >> BLOCK_BITS) - 1
        if offset < 0 or block < 0:
            return 0
        if self.keys[block] < offset >> BLOCK_BITS:
            return self.before[block + 1]
        return self.before[block] + self.containers[block].rank(offset & ((1 << BLOCK_BITS) - 1))

    def __contains__(self, offset: int) -> bool:
        return self.rank(offset) > self.rank(offset - 1)

    @property
    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.containers)
