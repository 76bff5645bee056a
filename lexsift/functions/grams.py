"""Distinct byte trigrams of texts, in NumPy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are put in order at a time, so that a task's arrays stay small.
SLICE_BYTES = 1 << 20


def _slices(ends: np.ndarray):
    """Ranges of rows of about ``SLICE_BYTES``; a longer row is one by itself."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_BYTES, "right")) - 1)
        yield low, high
        low = high


def distinct_grams(texts: pa.Array) -> pa.Array:
    """Of each text the codes of its byte trigrams (the first byte highest), once each, rising."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    codes, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for low, high in _slices(ends):
        b = raw[ends[low] : ends[high]].astype(np.int64)
        lengths = np.where(valid[low:high], np.diff(ends[low : high + 1]), 0)
        row = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        if len(b) < 3:
            sizes.append(np.zeros(high - low, np.int64))
            continue
        keys = (row[:-2] << 24) | (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        keys = keys[(row[:-2] == row[2:]) & (lengths[row[:-2]] > 0)]
        keys.sort()
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
        codes.append((keys & 0xFFFFFF).astype(np.int32))
        sizes.append(np.bincount(keys >> 24, minlength=high - low))
    offsets = np.cumsum(np.concatenate(sizes))
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(codes))).cast(pa.list_(pa.int32()))


def gram_codes(text: Column) -> Column:
    """The codes of a text's distinct byte trigrams as an array, rising; empty for null and short texts."""

    @F.arrow_udf("array<int>")
    def codes(texts: pa.Array) -> pa.Array:
        return distinct_grams(texts)

    return codes(text)


def counted_codes(lists: pa.Array) -> pa.Array:
    """Of each list of codes, which may repeat, every code once and how often it stands there."""
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    codes, times, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for low, high in _slices(starts):
        row = np.repeat(np.arange(high - low), np.diff(starts[low : high + 1]))
        keys = np.sort((row << 32) | values[starts[low] : starts[high]])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        codes.append((keys[first] & 0xFFFFFFFF).astype(np.int32))
        times.append(np.diff(np.append(first, len(keys))).astype(np.int32))
        sizes.append(np.bincount(keys[first] >> 32, minlength=high - low))
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(times))], ["code", "times"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pairs)


def code_times(codes: Column) -> Column:
    """(code, times) of every code in an array of codes."""

    @F.arrow_udf("array<struct<code: int, times: int>>")
    def counted(lists: pa.Array) -> pa.Array:
        return counted_codes(lists)

    return counted(codes)


def gram_name(code: Column) -> Column:
    """A code as six hex digits."""
    return F.lpad(F.hex(code.cast("long")), 6, "0")
