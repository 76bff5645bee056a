import pytest
from pyspark.sql import functions as F

from lexsift.operators.search import search
from lexsift.plans.query import Case, Mode, Query
from lexsift.sources.tables import table

DOCS = [(1, "foo bar\nbaz\n"), (2, "FOO\nfoo foo\n"), (3, "a\0foo\n"), (4, None), (5, ""), (6, "été the étage\nthe\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_modes(docs):
    assert ids(search(docs, Query(("foo",), fixed=True, mode=Mode.FILES))) == [1, 2]
    counts = search(docs, Query(("foo",), fixed=True, mode=Mode.COUNT)).collect()
    assert {r["doc_id"]: r["n_lines"] for r in counts} == {1: 1, 2: 1}
    found = search(docs, Query(("foo",), fixed=True)).collect()
    assert sorted((r["doc_id"], r["line_no"], r["line"]) for r in found) == [(1, 1, "foo bar"), (2, 2, "foo foo")]
    assert search(docs, Query(("foo",), fixed=True, mode=Mode.QUIET)).first()["found"]
    assert not search(docs, Query(("nothing",), fixed=True, mode=Mode.QUIET)).first()["found"]


def test_case_and_words(docs):
    assert ids(search(docs, Query(("FOO",), case=Case.INSENSITIVE, mode=Mode.FILES))) == [1, 2]
    assert ids(search(docs, Query(("FOO",), case=Case.SMART, mode=Mode.FILES))) == [2]
    assert ids(search(docs, Query(("tage",), word=True, mode=Mode.FILES))) == []
    assert ids(search(docs, Query(("étage",), word=True, mode=Mode.FILES))) == [6]


def test_matches_stay_within_lines(docs):
    assert ids(search(docs, Query((r"bar[^x]baz",), mode=Mode.FILES))) == []
    assert ids(search(docs, Query((r"bar\sbaz",), mode=Mode.FILES))) == []
    assert ids(search(docs, Query((r"^baz$",), mode=Mode.FILES))) == [1]
    assert len(search(docs, Query(("x*",))).collect()) == 6  # every line of the documents that aren't binary


PATTERNS = [
    ("the", True, False), ("there", True, False), ("License", True, False), ("th", True, False), ("x", True, False), ("zzzzqq", True, False),
    ("the", True, True), ("tion", True, True), ("of", False, True), ("th.re", False, False), ("e[ra]+t.on", False, False), ("eaux|keit", False, False),
    ("ung(en)?", False, False), ("été", True, False), ("é", True, True), ("über", True, False), ("[A-Z]{4,}", False, False), ("***", True, False),
    ("password", True, False), ("Er\\.$", False, False), ("^The ", False, False), ("(?i)license", False, False), ("n the ", True, False),
]


@pytest.fixture(scope="module")
def indexed(spark, small, tmp_path_factory):
    from lexsift.store import Index

    index = Index(spark, str(tmp_path_factory.mktemp("index")))
    docs = table(spark, small, "documents").withColumnRenamed("source", "root")
    index.build(docs, segments=3)
    return index, docs


@pytest.mark.parametrize("pattern, fixed, word", PATTERNS)
def test_pruned_equals_scan(indexed, pattern, fixed, word):
    index, docs = indexed
    index.costs.__class__  # the default model; small tables prefer scans, so ask for the index
    query = Query((pattern,), fixed=fixed, word=word, mode=Mode.FILES)
    scanned = ids(search(docs, query))
    chosen = index.explain(query).plan
    assert ids(index.search(docs, query)) == scanned
    if chosen.kind != "scan":
        only = Query((pattern,), fixed=fixed, word=word, mode=Mode.FILES, indexed_only=True)
        assert ids(index.search(docs, only)) == scanned


def test_changed_and_new_documents_are_found(indexed, spark):
    index, docs = indexed
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.lit("a needle here")).otherwise(F.col("text")))
    fresh = spark.createDataFrame([(10**6, "another needle", "src0")], "doc_id long, text string, root string")
    live = edited.select("doc_id", "text", "root").unionByName(fresh)
    query = Query(("needle",), fixed=True, mode=Mode.FILES)
    assert ids(index.search(live, query)) == [7, 10**6]
    assert ids(index.search(live, Query(("needle",), fixed=True, mode=Mode.FILES, indexed_only=True))) == []


def test_plan_reads_the_index_by_filter(indexed):
    index, docs = indexed
    plan = index.scan_set(docs, Query(("there",), fixed=True, indexed_only=True))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "PushedFilters: [In(gram" in plan


def test_regex_lines_end_a_word_as_its_sql_does(spark, tmp_path):
    """the query's boundary is one of ASCII, so it also stands between ``un`` and ``è``."""
    import duckdb

    from lexsift.queries import ORACLE_SQL, QUERIES

    rows = [(1, "De unèenchle éviê.\nDe unten.\nDer un x."), (2, "Leou unèçchtion, éonê."), (3, "Die der_x.\nDie der.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["search_regex_lines"]).fetchall())
    assert [r[:2] for r in want] == [(1, 1), (1, 3), (2, 1), (3, 2)]
    assert sorted(map(tuple, QUERIES["search_regex_lines"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize(
    "pattern, line, hit",
    [
        (r"un\b", "unè", False), (r"un(?-u:\b)", "unè", True), (r"(?-u)un\B", "unè", False), (r"(?-u:\w)$", "è", False), (r"(?-u:[\W])$", "è", True),
        (r"(?-u:\d)", "٣", False), (r"(?-u:x)\d", "x٣", True), (r"(?-u)\bk(?u)\b", "k", True), (r"(?-u:\s)", "\u00a0", False),
    ],
)
def test_ascii_only(spark, pattern, line, hit):
    from lexsift.operators.search import matches

    row = spark.createDataFrame([(line,)], "line string").select(matches(F.col("line"), Query((pattern,))).alias("m")).first()
    assert row["m"] == hit
