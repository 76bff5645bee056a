import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexsift.functions import grams, numeric
from lexsift.functions.text import gram_lists, gram_rows, is_binary, lines, token_rows, truncate_pattern


def test_lines(spark):
    rows = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "\n"), (4, "x\r\ny"), (5, None), (6, "a\n\n")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["line_no"], r["line"]) for r in lines(rows).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (3, 1, ""), (4, 1, "x\r"), (4, 2, "y"), (6, 1, "a"), (6, 2, "")]


def test_grams_are_bytes(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "ab"), (3, ""), (4, "éa"), (5, "abcabc"), (6, None)], "doc_id int, text string")
    got = sorted((r["doc_id"], r["gram"]) for r in gram_rows(rows).collect())
    assert got == [(1, "656C6C"), (1, "68656C"), (1, "6C6C6F"), (4, "C3A961"), (5, "616263"), (5, "626361"), (5, "636162")]


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "étage x foo_1 foo_1 a-bc"), (2, None)], "doc_id int, text string")
    assert sorted(r["token"] for r in token_rows(rows).collect()) == ["bc", "foo_1", "tage"]


def fnv(raw: bytes, h: int) -> int:
    for b in raw:
        h = (h ^ b) * 1099511628211 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_fnv(spark):
    tokens = ["", "alpha", "the_quick_brown_fox", "été"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", numeric.fnv1a64(F.encode("t", "UTF-8")).alias("h"))
    assert {r["t"]: r["h"] for r in rows.collect()} == {t: fnv(t.encode(), 1469598103934665603) for t in tokens}


def test_crc_of_the_standard_vector(spark):
    assert spark.sql("SELECT crc32('123456789') c").first()["c"] == 0xCBF43926


def test_truncation_keeps_characters_whole(spark):
    cases = {"short": "short", "x" * 30: "x" * 30, "x" * 31: "x" * 27 + "...", "é" * 20: "é" * 13 + "..."}
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", truncate_pattern(F.col("p")).alias("t"))
    assert {r["p"]: r["t"] for r in rows.collect()} == cases


def test_binary(spark):
    rows = spark.createDataFrame([("a\0b",), ("ab",)], "t string").select(is_binary(F.col("t")).alias("b"))
    assert [r["b"] for r in rows.collect()] == [True, False]


def test_xor_of_words(spark):
    import struct

    cases = [b"", b"1234567", b"12345678", bytes(range(200)), b"\xff" * 24]
    rows = spark.createDataFrame([(bytearray(c),) for c in cases], "b binary").select("b", numeric.xor64(F.col("b")).alias("x"))
    for r in rows.collect():
        want = 0
        for i in range(0, len(r["b"]) // 8 * 8, 8):
            want ^= struct.unpack("<q", r["b"][i : i + 8])[0]
        assert r["x"] == want


REPEATED = [(1, "abcd"), (1, "bcde"), (2, "abc"), (None, "xyz"), (None, "xyzw"), (3, None), (4, "ab"), (5, "é€é€")]


def test_grams_of_repeated_and_null_ids(spark):
    """F10 to F12: grams are made distinct in their row, and over rows where an id is repeated."""
    rows = spark.createDataFrame(REPEATED, "doc_id long, text string")
    want = {(k, b[i : i + 3].hex().upper()) for k, t in REPEATED if t for b in (t.encode(),) for i in range(len(b) - 2)}
    got = [tuple(r) for r in gram_rows(rows).collect()]
    assert len(got) == len(want) and set(got) == want
    lists = [(r["doc_id"], f"{c:06X}") for r in gram_lists(rows).collect() for c in r["codes"]]
    assert len(lists) == len(want) and set(lists) == want
    assert sorted(t for t in [r["token"] for r in token_rows(rows.filter("doc_id = 1")).collect()]) == ["abcd", "bcde"]


def test_distinct_ids_need_no_shuffle_of_pairs(spark):
    rows = spark.createDataFrame([(1, "abcabc"), (2, "abc"), (3, None)], "doc_id long, text string")
    for df in (gram_rows(rows), token_rows(rows)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, gram_rows(rows).collect())) == [(1, "616263"), (1, "626361"), (1, "636162"), (2, "616263")]


@pytest.mark.parametrize("size", [1, 3, 5, 1 << 20])
def test_grams_in_slices(size, monkeypatch):
    monkeypatch.setattr(grams, "SLICE_BYTES", size)
    texts = ["abcabc", None, "", "ab", "abc", "é€x" * 3, "aaaa", "ab"]
    want = [sorted({int.from_bytes(b[i : i + 3]) for i in range(len(b) - 2)}) for b in ((t or "").encode() for t in texts)]
    assert grams.distinct_grams(pa.array(texts)).to_pylist() == want
    assert grams.distinct_grams(pa.array(texts)[2:]).to_pylist() == want[2:] and grams.distinct_grams(pa.array(texts)[:0]).to_pylist() == []
