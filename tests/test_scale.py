"""What grows with the number of documents: no (document, gram) pair is shuffled by its document, no list
is put in order twice, and no shard of words is put in order at all."""

import re

import duckdb
import pytest

from lexsift.operators import maintenance
from lexsift.operators.index import posting_blocks, word_blocks
from lexsift.queries import ORACLE_SQL, QUERIES

PAIRS = re.compile(r"hashpartitioning\([^)]*\b(?:doc_id|local_id)#[^)]*\b(?:g|gram|code|token)#")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "compact_postings",
        "word_block_layout",
        "validate_monotonic",
        "posting_block_layout",
        "segment_size_model",
        "index_status",
        "engine_counters",
        "pruned_equals_scan",
    ],
)
def test_no_pairs_by_document(spark, small, name):
    assert not PAIRS.search(plan(QUERIES[name](spark, small)))


def test_merged_arrays(spark):
    lists = spark.createDataFrame([(0, 0, [7, 8]), (1, 0, [8])], "segment_id int, local_id long, codes array<int>")
    got = maintenance.merged(lists, maintenance.remap(lists.drop("codes")), "codes").collect()
    assert sorted((r["local_id"], r["codes"]) for r in got) == [(0, [7, 8]), (1, [8])]


def test_word_blocks_follow_from_counts(spark):
    from pyspark.sql import functions as F

    tokens = ["ab", "abc", "abcd", "abce", "Ab", "b1", "a_", "zz"]
    entries = [(d, t) for d in range(40) for i, t in enumerate(tokens) if d % (i + 1) == 0]
    got = word_blocks(spark.createDataFrame(entries, "doc_id long, token string"), F.lower(F.substring("token", 1, 1)), block=7)
    assert "row_number" not in plan(got)
    want = {}
    for shard in {t[0].lower() for t in tokens}:
        rows = [t for t, _ in sorted((t, d) for d, t in entries if t[0].lower() == shard)]
        for i in range(0, len(rows), 7):
            want[shard, i // 7] = (rows[i], rows[i : i + 7][-1], len(rows[i : i + 7]))
    assert {(r["shard"], r["block_no"]): (r["first_token"], r["last_token"], r["n"]) for r in got.collect()} == want


def test_lists_rise(spark):
    rows = [("a", 1, [5, 6]), ("a", 2, [6]), ("b", 1, [5]), ("b", 1, [5, 7]), ("b", None, [9]), ("c", 3, [])]
    lists = spark.createDataFrame(rows, "lang string, doc_id long, codes array<int>")
    got = {r["lang"]: (r["lists"], r["entries"], r["all_increasing"]) for r in maintenance.increasing_lists(lists, by=("lang",)).collect()}
    assert got == {"a": (2, 3, True), "b": (3, 4, False)}


def test_lists_are_put_in_order_once(spark):
    rows = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(200)], "code int, doc_id long")
    blocks = posting_blocks(rows, "code")
    assert plan(blocks).count("Window [") == 1
    got = sorted((r["code"], r["block_no"], r["n"], r["max_id"], r["encoded_bytes"]) for r in blocks.collect())
    assert got == [(c, *b) for c in (1, 2) for b in ((0, 128, 127, 128), (1, 72, 199, 2 + 71))]


def test_pruning_of_no_documents(spark, tmp_path):
    """Every literal has its row, also where there is nothing to find."""
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["pruned_equals_scan"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(ORACLE_SQL["pruned_equals_scan"]).fetchall())
