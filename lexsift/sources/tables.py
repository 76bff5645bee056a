"""The test tables, and documents as a corpus of roots and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, root, path, byte_length, text): a document's root is its source, its path lang/id.txt."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.col("source").alias("root"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("byte_length"),
        "text",
    )


def number_roots(docs: DataFrame) -> DataFrame:
    """With root_id: roots in order from 0. The order is over the few distinct roots only."""
    from pyspark.sql import Window

    roots = docs.select("root").distinct().withColumn("root_id", (F.row_number().over(Window.orderBy("root")) - 1).cast("long"))
    return docs.join(F.broadcast(roots) if roots.count() <= 100_000 else roots, "root")
