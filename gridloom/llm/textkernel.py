"""Vectorised word and n-gram hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, so the rules are the same for
every language. All hashes are 64 bit and depend on nothing but the bytes; two different words
or n-grams get equal hashes with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What separates words of letters and digits: every other ASCII byte.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text handled at once, so that the work arrays stay in the CPU's cache.
SLICE = 1 << 19
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = U(0xD6E8FEB86659FD93)
_GRAM_INV = U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        filled, step = 1, base
        while filled < len(out):
            take = min(filled, len(out) - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
            step = U(int(step) * int(step) & 0xFFFFFFFFFFFFFFFF)
        _powers[int(base)] = have = out
    return have[:n]


class Words:
    """The words of some texts, one after the other.

    first, last: of each word the byte offsets in data (last exclusive); hash: 64 bits;
    doc_first: of each text the index of its first word, and the number of words at the end.
    """

    __slots__ = ("data", "first", "last", "hash", "doc_first", "doc_byte", "raw", "total")

    def __init__(self, raw: np.ndarray, doc_byte: np.ndarray, lower: bool = True, space: np.ndarray = SPACE):
        self.raw, self.doc_byte = raw, doc_byte
        data = LOWER[raw] if lower else raw
        self.data = data
        n = len(data)
        inside = ~space[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = doc_byte[1:-1]
        edges = edges[edges < n]
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
        self.first = np.flatnonzero(begins)
        self.last = np.flatnonzero(ends) + 1
        self.total = total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=total[1:])
        self.hash = mix((total[self.last] - total[self.first]) * powers(_BASE_INV, n + 1)[self.first] + (self.last - self.first).astype(np.uint64))
        self.doc_first = np.searchsorted(self.first, doc_byte)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_first)

    def heads(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each longer word, unlike any word's; the word's own else."""
        long = self.last - self.first > n
        out = self.hash.copy()
        a = self.first[long]
        out[long] = mix(((self.total[a + n] - self.total[a]) * powers(_BASE_INV, len(self.data) + 1)[a]) ^ U(0xA5A5A5A5A5A5A5A5))
        return out

    def grams(self, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; the last n-1 of all have none."""
        return grams(self.hash, n, seed)

    def whole(self, seed: int = 0) -> np.ndarray:
        """Hash of each text's word sequence."""
        total = _totals(self.hash, seed)
        a, b = self.doc_first[:-1], self.doc_first[1:]
        return mix((total[b] - total[a]) * powers(_GRAM_INV, len(self.hash) + 1)[a] + (b - a).astype(np.uint64))

    def spans(self, a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the words a..b-1 for arrays of a and b."""
        total = _totals(self.hash, seed)
        return mix((total[b] - total[a]) * powers(_GRAM_INV, len(self.hash) + 1)[a] + (b - a).astype(np.uint64))


def _totals(hashes: np.ndarray, seed: int) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, np.uint64)
    x = mix(hashes + U(seed)) if seed else hashes
    np.cumsum(x * powers(_GRAM, len(hashes)), out=total[1:])
    return total


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = _totals(hashes, seed)
    return mix((total[n:] - total[:-n]) * powers(_GRAM_INV, m) + U(n))


def slices(column: pa.Array, lower: bool = True, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row exclusive, their words) over a string column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        end = min(end, n)
        yield row, end, Words(data[at[row] : at[end]], at[row : end + 1] - at[row], lower, space)
        row = end


def texts(values: list[str | None], lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    return slices(pa.array(values, pa.string()), lower)


class Lookup:
    """Positions of 64-bit hashes in a fixed set of distinct ones; -1 where missing."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(1, min(20, int(len(keys)).bit_length() + 1))
        self.shift = U(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not self.longest:
            return out
        bucket = (h >> self.shift).astype(np.int32)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.longest):
            hit = self.keys[at[left]] == h[left]
            out[left[hit]] = self.order[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return out


class Tally:
    """Sums of counts by 64-bit key, kept short by merging now and then."""

    def __init__(self, width: int = 1, most: int = 1 << 20):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.width, self.most, self.size = width, most, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys; counts of shape (n, width)."""
        self.keys.append(keys)
        self.counts.append(counts.reshape(len(keys), self.width))
        self.size += len(keys)
        if self.size > 2 * self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty((0, self.width), np.int64)
        keys = np.concatenate(self.keys)
        counts = np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        keys, counts = keys[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts

    def full(self) -> bool:
        """Whether even the merged sums are many, so that they should go out."""
        return self.size > self.most and len(self.merge()[0]) > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.keys, self.counts, self.size = [], [], 0
        return out


def signed(x: np.ndarray) -> pa.Array:
    """Hashes as Spark's longs."""
    return pa.array(x.view(np.int64))
