import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexsift.llm.textkernel import Lookup, distinct_sorted, shingles, slices, span_hashes, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabABé \x1c", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 64))
def test_words_and_shingles(texts, limit):
    seen = {}
    for first, buf, offs in slices(pa.array(texts, pa.string()), limit):
        rows, starts, ends, hashes = words(buf, offs, True)
        for i in range(len(offs) - 1):
            own = [buf[s:e].tobytes() for s, e in zip(starts[rows == i], ends[rows == i], strict=True)]
            want = re.findall(rb"[^\x20\x09-\x0D]+", (texts[first + i] or "").encode())
            assert own == want
            for h, w in zip(hashes[rows == i].tolist(), want, strict=True):
                assert seen.setdefault(h, w.lower()) == w.lower()
            r, s, _ = shingles(rows, hashes, 3)
            low = [w.lower() for w in want]
            count = len({tuple(low[j : j + 3]) for j in range(max(1, len(low) - 2))}) if low else 0
            assert len(set(s[r == i].tolist())) == count
    assert len(set(seen.values())) == len(seen)


def test_equal_spans_hash_alike():
    buf = np.frombuffer(b"xxabcdeyyyabcdez", np.uint8)
    h = span_hashes(buf, np.array([2, 10, 3]), np.array([7, 15, 8]))
    assert h[0] == h[1] != h[2]


def test_distinct_sorted():
    values, bounds = distinct_sorted(np.array([1, 0, 1, 1]), np.array([5, 9, 5, 2], np.uint64), 3)
    assert values.tolist() == [9, 2, 5] and bounds.tolist() == [0, 1, 3, 3]


def test_lookup_finds_or_says_so():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = Lookup(keys, np.arange(len(keys), dtype=np.float64))
    values, found = table.find(keys)
    assert found.mean() > 0.95 and (values[found] == np.arange(len(keys))[found]).all()
    assert not table.find(keys + np.uint64(2**63))[1].any()
    assert not Lookup(keys[:0], np.zeros(0)).find(keys)[1].any()
