"""Words and shingles of whole Arrow string columns, in NumPy.

A column of strings is one UTF-8 buffer with offsets. Words (maximal runs of anything but the six
ASCII white-space bytes) are found by mask, and hashed all at once by a running sum over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240501))
#: 64 random bits a byte; FOLDED gives A-Z those of a-z.
BYTE_BITS = _RNG.integers(0, 2**64, 256, np.uint64)
FOLDED_BITS = BYTE_BITS.copy()
FOLDED_BITS[65:91] = BYTE_BITS[97:123]
WORD_MULTIPLIERS = _RNG.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 23:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20, most_rows: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``limit`` bytes; a longer row comes alone.

    Null is the empty text. Offsets start at 0 and have one more entry than the run has rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, row + most_rows)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray = BYTE_BITS) -> np.ndarray:
    """A hash of the bytes of each span; the same bytes hash alike wherever they stand."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(bits[buf] * _power("base", _BASE, len(buf)), out=sums[1:])
    inverse = _power("inverse", _INVERSE, len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offs: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word, in order."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none.astype(np.uint64)
    inside = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= edge[:n]
    starts = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= edge[1:]
    ends = np.flatnonzero(inside & after) + 1
    hashes = span_hashes(buf, starts, ends, FOLDED_BITS if fold_case else BYTE_BITS)
    rows = np.searchsorted(offs, starts, "right") - 1
    return rows, starts, ends, hashes


def shingles(rows: np.ndarray, hashes: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, index of its first word) of every run of k words in a row.

    With ``short``, a row of fewer words has them all as its only shingle.
    """
    n = len(rows)
    m = max(0, n - k + 1)
    whole = rows[:m] == rows[k - 1 :] if m else np.zeros(0, bool)
    value = np.full(m, np.uint64(k))
    for j in range(k):
        value += hashes[j : j + m] * WORD_MULTIPLIERS[j]
    at = np.flatnonzero(whole)
    out_rows, out = rows[at], mix(value[at])
    if short and n:
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        count = np.diff(np.append(first, n))
        few = first[count < k]
        if len(few):
            size = count[count < k]
            value = size.astype(np.uint64)
            for j in range(k - 1):
                has = size > j
                value[has] += hashes[few[has] + j] * WORD_MULTIPLIERS[j]
            out_rows, out, at = np.append(out_rows, rows[few]), np.append(out, mix(value)), np.append(at, few)
    return out_rows, out, at


def distinct_sorted(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, one row after another: (values, offsets)."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        keep = np.concatenate(([True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])))
        rows, values = rows[keep], values[keep]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class Lookup:
    """64-bit keys to values, by two hashed tables; what fits in neither is left to the caller."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        for turn in range(2):
            bits = max(8, int(4 * len(keys)).bit_length())
            slot = self._slot(keys, turn, bits)
            table_keys = np.full(1 << bits, ~np.uint64(0))
            table_values = np.zeros(1 << bits, values.dtype)
            table_keys[slot] = keys
            placed = table_keys[slot] == keys
            table_values[slot[placed]] = values[placed]
            self.tables.append((bits, table_keys, table_values))
            keys, values = keys[~placed], values[~placed]

    @staticmethod
    def _slot(keys: np.ndarray, turn: int, bits: int) -> np.ndarray:
        return (keys * WORD_MULTIPLIERS[8 + turn]) >> np.uint64(64 - bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        bits, table_keys, table_values = self.tables[0]
        slot = self._slot(keys, 0, bits)
        found = table_keys[slot] == keys
        values = table_values[slot]
        missing = np.flatnonzero(~found)
        if len(missing):
            bits, table_keys, table_values = self.tables[1]
            slot = self._slot(keys[missing], 1, bits)
            ok = table_keys[slot] == keys[missing]
            found[missing[ok]] = True
            values[missing[ok]] = table_values[slot[ok]]
        return values, found


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each row has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts summed."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def least_count(histogram: list, most: int) -> int:
    """The least count such that at most ``most`` keys have it or more. histogram: (n, keys), any order."""
    total, least = 0, 1 << 62
    for n, keys in sorted(histogram, reverse=True):
        total += keys
        if total > most:
            break
        least = n
    return least
