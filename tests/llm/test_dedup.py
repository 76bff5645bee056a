"""Operators 6 and 10 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lexsift.llm import jaccard, suffix
from lexsift.llm.common import materialize
from lexsift.llm.components import connected_components
from lexsift.llm.jaccard import jaccard_components, one_of_each
from lexsift.llm.suffix import remove_repeats

from .conftest import prose


def test_suffix_array_sorts():
    rng = random.Random(1)
    for _ in range(60):
        n, letters = rng.randint(1, 200), rng.choice(["a", "ab", "abcdefgh"])
        s = "".join(rng.choice(letters) for _ in range(n)) * rng.choice([1, 3])
        text = np.frombuffer(s.encode(), np.uint8).astype(np.uint16)
        got = suffix.two_stage_suffix_array(text, 1 << 10)
        assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        share = suffix.common_prefixes(text, got, 50)
        for k in range(1, len(got)):
            a, b = s[got[k - 1] :], s[got[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert min(same, 50) == share[k] or same == min(len(a), len(b))


def test_equal_strings_have_equal_anchors():
    rng = random.Random(2)
    a = "".join(rng.choice("abcd ") for _ in range(400))
    raw = (a + a[50:300] + "x" * 450 + "z").encode()
    offs = np.array([0, 300, len(raw)])
    first, last, h, again = suffix.anchors(np.frombuffer(raw, np.uint8), offs)
    of = {i: anchor for a, z, anchor in zip(first.tolist(), last.tolist(), h.tolist(), strict=True) for i in range(a, z + 1)}
    assert sorted(of) == [i for i in range(len(raw) - 99) if not i < 300 < i + 100]
    assert (last - first).max() < suffix.LONGEST
    for a, z, may in zip(first.tolist(), last.tolist(), again.tolist(), strict=True):
        assert may or len({raw[i : i + 100] for i in range(a, z + 1)}) == z - a + 1
    assert 0 < again.sum() < 10
    same = {}
    for i, anchor in of.items():
        assert same.setdefault(raw[i : i + 100], anchor) == anchor


def plain_removal(docs):
    seen, out = set(), {}
    for key, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removal_docs(spark):
    rng = random.Random(7)
    passage, other = prose(rng, 30), prose(rng, 25)
    data = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 1), passage)
        if i % 5 == 0:
            parts.append(other[rng.randint(0, 20) :])
        data.append((i * 3 % 61, " ".join(parts)))
    data += [(70, data[3][1]), (71, data[3][1]), (72, "z" * 500), (73, "ab" * 300), (74, "z" * 120), (75, None), (76, ""), (77, passage[:99]), (78, "é" * 90)]
    return spark.createDataFrame(data, "doc_id long, text string")


@pytest.mark.parametrize("bucket, often", [(4096, 64), (8, 2)])
def test_removal_equals_brute_force(spark, bucket, often):
    """Small buckets make every shared anchor a hot one that is split, and a low count a common one."""
    docs = materialize(removal_docs(spark), "removal")
    want = plain_removal(sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs, bucket, (1000, often)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 5000


def test_removal_of_odd_documents(odd_docs, no_docs):
    got = suffix.remove_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count() and suffix.remove_repeats(no_docs).count() == 0
    twice = sorted(r["n_removed"] for r in got if r["doc_id"] == 2)
    assert twice == [r["n_bytes"] for r in got if r["doc_id"] == 2]  # both copies follow document 1
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [0]
    for r in got:
        assert r["n_removed"] == sum(x["end"] - x["start"] for x in r["removed"])


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(rows, k, num, den):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(rng):
    """Chains of copies, each further from the first, groups about one text, and unrelated ones."""
    rows, n = [], 0
    for size in (12, 40, 90, 200):
        base = prose(rng, size).split()
        for chain in range(2):
            words = list(base)
            for _ in range(9):
                rows.append((n, " ".join(words)))
                n += 1
                words = list(words if chain else base)
                for _ in range(rng.randint(0, max(1, size // 60))):
                    words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    rows += [(n + i, prose(rng, rng.randint(0, 4))) for i in range(25)]
    rows += [(500, rows[5][1]), (501, rows[5][1].upper()), (502, None), (503, ""), (504, " \n"), (None, rows[7][1]), (None, "only here with no id"), (505, "a b"), (506, "A  b"), (507, "b a")]
    return rows


@pytest.mark.parametrize("k, num, block", [(3, 90, 2048), (5, 80, 2), (1, 60, 3)])
def test_components_equal_brute_force(spark, k, num, block):
    rows = near_copies(random.Random(k))
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "near")
    got = jaccard_components(docs, k, num, 100, block).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows, k, num, 100)


def test_one_of_each(spark, odd_docs, no_docs):
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and one_of_each(no_docs).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids or ids.count(1) == 1 and not {2, 3} & set(ids)
    assert {4, 5, 6, 7, 10} <= set(ids) and len([i for i in ids if i is None]) == 2


def test_components_of_a_long_path(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 102), (102, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(links.filter("false")).count() == 0


@pytest.fixture
def shifting(spark, monkeypatch):
    """Documents whose files are split otherwise at every later scan."""
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(40)]
    texts[20:30] = texts[:10]
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9, "doc_id"), "shifting")
    name, turn = "spark.sql.files.maxPartitionBytes", [0]

    def write(*args):
        out = materialize(*args)
        turn[0] += 1
        spark.conf.set(name, "64k" if turn[0] % 2 else "128m")
        return out

    for module in (suffix, jaccard):
        monkeypatch.setattr(module, "materialize", write)
    spark.conf.set(name, "128m")
    yield docs
    spark.conf.unset(name)


def test_rows_keep_their_numbers(shifting):
    kept = one_of_each(shifting).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(20), *range(30, 40)]
    want = plain_removal([(r["doc_id"], r["text"].encode()) for r in shifting.orderBy("doc_id").collect()])
    got = remove_repeats(shifting).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
