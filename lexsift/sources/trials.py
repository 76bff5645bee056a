"""Timed trials from CSV, and reports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pattern string, category string, trial string, condition string, ours_ms string, scan_ms string, files string"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """One row per trial and tool (tool, pattern, category, trial, condition, time_ms). Numbers may be
    padded with zeros, so they are read as text first; columns go by place, after one header line."""
    wide = spark.read.csv(path, header=True, schema=SCHEMA, enforceSchema=True)
    tools = F.expr("stack(2, 'ours', ours_ms, 'scan', scan_ms) as (tool, time_ms)")
    rows = wide.select("pattern", "category", F.col("trial").cast("int").alias("trial"), "condition", tools)
    return rows.withColumn("time_ms", F.col("time_ms").cast("long"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line): every row as a line of a Markdown table; bars in cells are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header and fields quoted where they must be; as many files as there are partitions."""
    df.write.mode("overwrite").csv(path, header=True)
