from lexsift.operators import candidates, hints, maintenance, stats
from lexsift.operators.index import assign_ids, posting_blocks


def test_cost_counts_missing_grams_as_none(spark):
    freq = spark.createDataFrame([(1, "A", 5), (1, "B", 3), (2, "A", 9)], "segment_id int, gram string, doc_freq long")
    segments = spark.createDataFrame([(1, 10, 100), (2, 20, 300), (3, 1, 1)], "segment_id int, docs long, source_bytes long")
    assert tuple(candidates.cost(freq, segments, ("A", "B")).first()) == (31, 401, 3)
    assert tuple(candidates.cost(freq, segments, ("A",)).first()) == (31, 401, 14)


def test_empty_inputs(spark):
    log = spark.createDataFrame([], "ord long, txn long, op string, key string")
    assert maintenance.committed(log).count() == 0
    entries = spark.createDataFrame([], "gram string, doc_id long")
    assert maintenance.increasing(entries).first()["all_increasing"] and posting_blocks(entries).count() == 0
    cache = spark.createDataFrame([], "pattern string, flags int, generation int, file_ids array<bigint>, cached_at int")
    assert tuple(hints.status(cache, 1).first()) == (0, 0, 0)


def test_blocks_begin_with_whole_ids(spark):
    rows = spark.createDataFrame([("A", i * 1000) for i in range(300)], "gram string, doc_id long")
    got = {r["block_no"]: (r["n"], r["max_id"], r["encoded_bytes"]) for r in posting_blocks(rows).collect()}
    assert got == {0: (128, 127000, 1 + 127 * 2), 1: (128, 255000, 3 + 127 * 2), 2: (44, 299000, 3 + 43 * 2)}


def test_ids_restart_in_each_segment(spark):
    docs = spark.createDataFrame([(0, 0, "b"), (0, 0, "a"), (1, 0, "c"), (0, 1, "a")], "segment_id int, root_id int, path string")
    got = {(r["segment_id"], r["root_id"], r["path"]): r["local_id"] for r in assign_ids(docs).collect()}
    assert got == {(0, 0, "a"): 0, (0, 0, "b"): 1, (0, 1, "a"): 2, (1, 0, "c"): 0}


def test_medians(spark):
    rows = spark.createDataFrame([("a", 4), ("a", 2), ("b", 0), ("b", (1 << 63) - 1), ("c", 7)], "k string, time_ms long")
    got = {r["k"]: (r["least"], r["median"], r["p95"], r["greatest"]) for r in stats.trial_stats(rows, ("k",)).collect()}
    assert got["a"] == (2, 3, 4, 4) and got["c"] == (7, 7, 7, 7) and got["b"][1] == ((1 << 63) - 1) // 2


def test_full_hint_cycle(spark):
    schema = "pattern string, flags int, generation int, file_ids array<bigint>, cached_at int"
    cache = spark.createDataFrame([("p", 0, 1, [1, 2], 5), ("q", 0, 1, [3], 6)], schema)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, path string")
    assert [r["path"] for r in hints.lookup(cache, docs, "p", 0, 1).collect()] == ["a", "b"]
    assert hints.lookup(cache, docs, "q", 0, 1).count() == 0 and hints.lookup(cache, docs, "p", 1, 1).count() == 0
