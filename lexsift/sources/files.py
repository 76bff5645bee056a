"""Live files as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import indexable


def read_files(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """(path, byte_length, modified, content, text, can_index) of all regular files under ``paths``.

    Files are read as Spark's binary source gives them, which never lists names that begin with a dot
    or an underscore. UTF-16 with a byte-order mark is decoded; other bytes are read as UTF-8.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive)).load(list(paths))
    return files.select(
        "path",
        F.col("length").alias("byte_length"),
        F.col("modificationTime").alias("modified"),
        "content",
        decode(F.col("content")).alias("text"),
        indexable(F.col("length"), F.col("content")).alias("can_index"),
    )


def decode(content: Column) -> Column:
    mark = F.substring(content, 1, 2)
    wide = mark.isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    return F.when(wide, F.decode(content, "UTF-16")).otherwise(F.make_valid_utf8(content.cast("string")))


def is_hidden(path: Column) -> Column:
    """Whether a name of the path begins with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def without(files: DataFrame, folder: str) -> DataFrame:
    """Leave out the engine's own folder."""
    return files.filter(~F.col("path").startswith(folder.rstrip("/") + "/"))
