"""The registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexsift.llm.common import materialize, table
from lexsift.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    mine = sorted(tuple(r[c] for c in order) for r in df.collect())
    theirs = sorted(tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall())
    assert mine == theirs


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), "stage")
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.agg(F.max("bin_words")).first()[0] <= 2048
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, ran.collect())) == sorted(map(str, packed.collect()))


def test_pipeline_on_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for given in (docs, no_docs.select(*docs.columns)):
        for _, stage in corpus_pipeline.STAGES:
            given = materialize(stage(spark, given, SMALL), "odd-stage")
