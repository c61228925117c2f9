"""Periodic runs of words: Lyndon words by suffix grouping, extended by common extensions."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import short_batches

MIN_LENGTH = 12
# Words that are searched together; a longer document is searched by itself.
GROUP_WORDS = 1 << 19

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_RUN)), ("collapsed", pa.string())])
_SQL_TYPE = "n_words long, spans array<struct<start: long, length: long, period: long>>, collapsed string"
_BASE = random.Random(13).getrandbits(64) | 1
_GOLDEN, _SHIFTS = 0x9E3779B97F4A7C15, (30, 27, 31)


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping.

    Suffixes are grouped by their first symbol, and groups are taken from the
    highest to the lowest. A group's context is the Lyndon word that all its
    suffixes begin with. When a group is taken, each stretch of its contexts
    side by side is given to the context before it, which grows by them;
    places of one group that get equally many form the group that comes right
    after theirs. A context is final once its group is taken.
    """
    n = len(symbols)
    places: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        places.setdefault(symbol, []).append(i)
    alphabet = sorted(places)
    name = {symbol: g for g, symbol in enumerate(alphabet)}
    group = [name[symbol] for symbol in symbols]
    members = [places[symbol] for symbol in alphabet]
    width = [1] * len(alphabet)
    lower, upper = list(range(-1, len(alphabet) - 1)), list(range(1, len(alphabet) + 1))
    before = list(range(-1, n))  # by the first place of a context: that of the context before it
    lengths = [0] * n
    current = len(alphabet) - 1
    while current >= 0:
        own, gains = width[current], {}
        for i in members[current]:
            if group[i] == current:
                lengths[i] = own
                owner = before[i + own] = before[i]
                if owner >= 0:
                    gains[owner] = gains.get(owner, 0) + 1
        members[current] = None
        moved: dict[tuple[int, int], list[int]] = {}
        for owner, gain in gains.items():
            moved.setdefault((gain, group[owner]), []).append(owner)
        # Larger gains first: what comes right after the old group later lies below them.
        for gain, old in sorted(moved, reverse=True):
            new, owners = len(width), moved[gain, old]
            width.append(width[old] + gain * own)
            members.append(owners)
            lower.append(old)
            upper.append(upper[old])
            lower[upper[old]] = new
            upper[old] = new
            for owner in owners:
                group[owner] = new
        current = lower[current]
    return lengths


def _values(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit value for each symbol, its bits well mixed."""
    x = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN)
    for shift in _SHIFTS:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(_BASE)
    return x


class Extensions:
    """Common extensions of places in a sequence, from hashes of its prefixes.

    Equal words always have equal hashes, so an extension is never too short.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.powers = np.full(self.n + 1, _BASE, dtype=np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values(symbols) * self.powers[:-1])])

    def _longest(self, room: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        length = np.zeros(len(room), dtype=np.int64)
        for bit in reversed(range(int(room.max(initial=0)).bit_length())):
            longer = length + (1 << bit)
            at = np.flatnonzero(longer <= room)
            at = at[equal(at, longer[at])]
            length[at] = longer[at]
        return length

    def _same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        p = self.prefix
        return (p[i + length] - p[i]) * self.powers[j - i] == p[j + length] - p[j]

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and from ``j > i`` on."""
        return self._longest(self.n - j, lambda at, k: self._same(i[at], j[at], k))

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words up to ``i`` and up to ``j > i``, both left out."""
        return self._longest(i, lambda at, k: self._same(i[at] - k, j[at] - k, k))


class PlainExtensions:
    """The same, compared word by word: what remains if hashes ever collide."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols

    @staticmethod
    def _equal(a: np.ndarray, b: np.ndarray) -> int:
        same = a == b
        return len(same) if same.all() else int(np.argmin(same))

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s, n = self.symbols, len(self.symbols)
        return np.array([self._equal(s[a : n - b + a], s[b:]) for a, b in zip(i, j)], dtype=np.int64)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = self.symbols
        return np.array([self._equal(s[:a][::-1], s[b - a : b][::-1]) for a, b in zip(i, j)], dtype=np.int64)


def _extended(symbols: np.ndarray, roots: list[np.ndarray], extensions, min_length: int) -> np.ndarray:
    found = []
    for length in roots:
        i = np.flatnonzero(np.arange(len(symbols)) + length < len(symbols))
        j = i + length[i]
        # A run goes on beyond its root, to the right or to the left.
        near = (symbols[i] == symbols[j]) | ((i > 0) & (symbols[i - 1] == symbols[j - 1]))
        i, j = i[near], j[near]
        left, right = extensions.before(i, j), extensions.after(i, j)
        period = j - i
        total = left + period + right
        long = total >= np.maximum(min_length, 2 * period)
        found.append(np.column_stack([i - left, total, period])[long])
    return np.unique(np.concatenate(found), axis=0)


def _holds(symbols: np.ndarray, found: np.ndarray) -> bool:
    """Whether every run found repeats with its period and its neighbours do not."""
    n = len(symbols)
    for start, length, period in found.tolist():
        end = start + length
        if not np.array_equal(symbols[start : end - period], symbols[start + period : end]):
            return False
        if (start and symbols[start - 1] == symbols[start - 1 + period]) or (end < n and symbols[end] == symbols[end - period]):
            return False
    return True


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """``(start, length, period)`` of every run of at least ``min_length`` symbols, by start, then length.

    Each run holds a Lyndon word of its period's length that is the longest one
    at its place, under the order of the symbols or under the reverse order, so
    extending the longest Lyndon words of both orders on both sides finds all.
    Runs found are compared with the sequence.
    """
    if len(symbols) < 2:
        return np.zeros((0, 3), dtype=np.int64)
    roots = [np.array(lyndon_lengths(s.tolist()), dtype=np.int64) for s in (symbols, -symbols)]
    found = _extended(symbols, roots, Extensions(symbols), min_length)
    return found if _holds(symbols, found) else _extended(symbols, roots, PlainExtensions(symbols), min_length)


def _stretches(symbols: np.ndarray, owner: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the stretches of documents that can hold a run.

    A run of period p and length n >= max(min_length, 2p) agrees with itself p
    words on for n - p words, which are at least half of ``min_length``. So all
    its words lie in grams of that many words that the document repeats.
    """
    gram = -(-min_length // 2)
    if len(symbols) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, n_grams = _values(symbols), len(symbols) - gram + 1
    hashed = _values(owner[:n_grams])
    for k in range(gram):
        hashed = hashed * np.uint64(_BASE) + values[k : k + n_grams]
    at = np.flatnonzero(owner[:n_grams] == owner[gram - 1 :])
    _, inverse, counts = np.unique(hashed[at], return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    if not len(at):
        return at, at
    breaks = (np.diff(at) > gram) | (np.diff(owner[at]) != 0)
    return at[np.concatenate([[True], breaks])], at[np.concatenate([breaks, [True]])] + gram


def runs_of_documents(documents: list[list], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of each document, a list of words; places are counted from its first word."""
    names: dict = {}
    symbols = np.array([names.setdefault(w, len(names)) for words in documents for w in words], dtype=np.int64)
    sizes = np.array([len(words) for words in documents], dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(documents)), sizes)
    starts, ends = _stretches(symbols, owner, min_length)
    # Stretches side by side, each followed by a symbol that occurs only there and so ends every run.
    place = np.concatenate([np.append(np.arange(a, b), -1 - k) for k, (a, b) in enumerate(zip(starts, ends))]) if len(starts) else np.zeros(0, np.int64)
    joined = np.where(place < 0, len(names) - place, symbols[place]) if len(place) else place
    found = find_runs(joined, min_length)
    found[:, 0] = place[found[:, 0]]
    holder = owner[found[:, 0]]
    found[:, 0] -= firsts[holder]
    found = found[np.lexsort((found[:, 2], found[:, 0], holder))]
    cuts = np.searchsorted(np.sort(holder), np.arange(len(documents) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], spans: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(spans):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, spans[:, 0] + spans[:, 2], 1)
    np.add.at(marks, spans[:, 0] + spans[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)])


def _struct_array(documents: list[list[bytes]], min_length: int) -> pa.StructArray:
    found: list[np.ndarray] = []
    group: list[list[bytes]] = []
    size = 0
    for words in documents:
        if group and size + len(words) > GROUP_WORDS:
            found += runs_of_documents(group, min_length)
            group, size = [], 0
        group.append(words)
        size += len(words)
    found += runs_of_documents(group, min_length) if group else []
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], fields=list(_RUN))
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
    left = [collapsed(words, spans_) for words, spans_ in zip(documents, found)]
    columns = [
        pa.array([len(words) for words in documents], type=pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), spans),
        pa.array(left, type=pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, fields=list(_TYPE))


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH, text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``__runs`` (n_words, spans, collapsed) added.

    ``spans`` holds every run of at least ``min_length`` words as (start,
    length, period), by start, then period; ``collapsed`` the words that no
    run holds after its first period, joined by one space. Each whole text is
    a row's own work, so nothing is shuffled and repeated rows get equal
    results. A null or empty text has no words and no runs, and its
    ``collapsed`` is empty. All columns of ``docs`` are kept, whatever their
    names. A task holds a few words lists of one document at a time, some
    hundred bytes for each word of its repeated stretches.
    """
    short_batches(docs.sparkSession)

    @F.arrow_udf(_SQL_TYPE)
    def runs(texts: pa.Array) -> pa.Array:
        return _struct_array([(raw or b"").split() for raw in texts.cast(pa.binary()).to_pylist()], min_length)

    return docs.withColumn("__runs", runs(F.col(text_col).cast("string")))
