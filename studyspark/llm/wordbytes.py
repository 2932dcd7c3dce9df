"""Words, lines and their hashes of whole Arrow text batches, in numpy.

A batch is cut into chunks of whole documents of about `CHUNK_BYTES`, so memory is bound by the
chunk and by the longest single text. Nothing here makes a Python object per word.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.ones(256, dtype=bool)
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_CODE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least `n` of each.

    Functions travel to executors by value, each task with globals of its own; the tables are kept
    once per process instead, so that a worker which serves many tasks doesn't gather copies.
    """
    kept = sys.modules.setdefault("_studyspark_powers", types.ModuleType("_studyspark_powers"))
    tables = getattr(kept, "tables", None)
    if tables is None or len(tables[0]) < n:
        tables = []
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 2**64))):
            steps = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        kept.tables = tables
    return tables


class Spans:
    """Prefix sums over the bytes of a chunk: the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=self._sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64))


@dataclass
class Chunk:
    """Some documents: their bytes, and where each begins and ends."""

    first: int  # row in the batch
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.begin)

    def runs(self, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the maximal byte runs inside documents that hold no byte
        of the lookup table `apart`."""
        inside = ~apart[self.data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        full = self.begin[self.begin < self.end]
        opens[full] = inside[full]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = self.end[self.begin < self.end] - 1
        closes[last] = inside[last]
        start = np.flatnonzero(opens)
        return start, np.flatnonzero(closes) + 1, self.owner(start)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs without the white space bytes 0x20 and 0x09 to 0x0D."""
        return self.runs(_SPACE)

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ASCII letters, digits and all other bytes from 0x80 on."""
        return self.runs(_MARK)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All \\n-separated lines, empty ones too; an empty document has one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        start = np.concatenate([self.begin, breaks + 1])
        own = np.concatenate([np.arange(self.n), self.owner(breaks)])
        order = np.lexsort((start, own))
        start, own = start[order], own[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        final = np.ones(len(own), bool)
        final[:-1] = own[1:] != own[:-1]
        end[final] = self.end[own[final]]
        return start, end, own

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        return _LOWER[self.data]

    def points(self) -> np.ndarray:
        """Prefix count of code points, one longer than the bytes."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a text column in order; null counts as empty text."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    begin, end = offsets[:-1].copy(), offsets[1:].copy()
    if texts.null_count:
        hole = np.asarray(texts.is_null())
        end[hole] = begin[hole]
    low = 0
    while low < n:
        high = int(np.searchsorted(end, begin[low] + limit, side="right"))
        high = min(max(high, low + 1), n)
        base = begin[low]
        yield Chunk(low, data[base : end[high - 1]], begin[low:high] - base, end[low:high] - base)
        low = high


def windows(hashes: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of `n` words inside one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(own[: len(own) - n + 1] == own[n - 1 :])
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * np.uint64(pow(int(_BASE), k, 2**64))
    return first, mix(total[first] + np.uint64(n))


def repeated(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the same hash stands more than once in the same document."""
    key = mix(hashes ^ (own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(key), bool)
    out[order] = same
    return out


def covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a window of `n` words that begins at one of `first`."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + n, -1)
    return np.cumsum(step[:-1]) > 0


def per_document(own: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum of whole numbers) by document."""
    if weight is None:
        return np.bincount(own, minlength=n).astype(np.int64)
    return np.rint(np.bincount(own, weights=weight, minlength=n)).astype(np.int64)
