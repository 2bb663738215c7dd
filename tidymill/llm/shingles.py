"""Hashes of words and word sequences of whole batches, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidymill.llm.common import mixed, seeded

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def _table(seed: int, fold: bool) -> np.ndarray:
    """A value for each of 256 places in a word and each byte; A-Z may count as a-z."""
    if (seed, fold) not in _TABLES:
        table = seeded(1 << 16, seed).reshape(256, 256)
        if fold:
            table[:, 65:91] = table[:, 97:123]
        _TABLES[seed, fold] = table.ravel()
    return _TABLES[seed, fold]


@dataclass
class Words:
    """Words of consecutive documents: where they lie in the bytes, and how many each document has."""

    data: np.ndarray
    letters: np.ndarray  # places of the bytes inside words
    starts: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray  # of each document's words

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        word = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if len(data):
            starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first[:-1]))
            ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | first[1:])) + 1
        else:
            starts = ends = np.zeros(0, np.int64)
        return cls(data, np.flatnonzero(word), starts, ends - starts, np.searchsorted(starts, offsets))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: the sum of a random value per place and byte, scrambled."""
        last = np.cumsum(self.sizes)
        inside = np.arange(len(self.letters)) - np.repeat(last - self.sizes, self.sizes)
        values = _table(seed, fold)[((inside & 255) << 8) | self.data[self.letters]]
        far = np.flatnonzero(inside >= 256)
        if len(far):
            values[far] = mixed(values[far] + (inside[far] >> 8).astype(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        return mixed(sums[last] - sums[last - self.sizes] + self.sizes.astype(np.uint64))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) + np.uint64(1))


def sequences(hashes: np.ndarray, count: int) -> np.ndarray:
    """Hashes of all runs of ``count`` neighbours, built by doubling."""
    power, out, width = hashes, None, 0
    span = 1
    while count:
        if count & 1:
            out = power if out is None else joined(out[: len(power[width:])], power[width:][: len(out)])
            width += span
        count >>= 1
        if count:
            power, span = joined(power[:-span], power[span:]) if len(power) > span else power[:0], 2 * span
    return out


def lowest(values: np.ndarray, count: int) -> np.ndarray:
    """The least of each ``count`` neighbours."""
    if len(values) < count:
        return values[:0]
    span = 1
    while 2 * span <= count:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = count - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, A-Z folded, sorted; one after the other, with their bounds.

    A document with fewer words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    words = Words.of(data, offsets)
    hashes, owners = words.hashes(seed, fold=True), words.owners()
    found, whose = [], []
    runs = sequences(hashes, size)
    if len(runs):
        whole = owners[: len(runs)] == owners[size - 1 :]
        found.append(runs[whole])
        whose.append(owners[: len(runs)][whole])
    counts = np.diff(words.bounds)
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            found.append(mixed(sequences(hashes, short)[words.bounds[rows]] + np.uint64(short)))
            whose.append(rows)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    values, rows = np.concatenate(found), np.concatenate(whose)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(offsets)))
