"""Where named queries are entered, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Enter a function (spark, sf_dir) under its name; without SQL only its rows are looked at."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return enter


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A small relation from the text of SQL VALUES, which both engines read."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")


#: SQL for the lines of ``documents``: a final line break starts no line, empty text has none.
LINES_SQL = """
lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (
    SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l
    FROM documents WHERE text <> '')
)"""

#: SQL for the distinct byte trigrams of ``documents``, in six hex digits.
GRAMS_SQL = """
grams AS (
  SELECT DISTINCT doc_id, hex(b[i:i + 2]) AS gram FROM (
    SELECT doc_id, b, unnest(range(1, octet_length(b) - 1)) AS i
    FROM (SELECT doc_id, encode(text) AS b FROM documents) WHERE octet_length(b) >= 3)
)"""

#: SQL for the distinct tokens of ``documents``.
TOKENS_SQL = """
tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z_]{2,}')) AS token FROM documents)"""
