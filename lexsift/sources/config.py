"""Settings and patterns that are read from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Case, last_case


def read_flags(text: str) -> list[str]:
    """``--flag`` or ``--flag=value`` a line; blank lines and ``#`` comments don't count."""
    return [s for s in map(str.strip, text.splitlines()) if s and not s.startswith("#")]


def case_of(text: str) -> Case:
    return last_case([], read_flags(text))


def flag_rows(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) -> (file, flag, value) of the last line that sets each flag."""
    trimmed = lines.withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    split = trimmed.select(
        "file",
        "line_no",
        F.regexp_extract("line", "^([^=]*)", 1).alias("flag"),
        F.when(F.col("line").contains("="), F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"),
    )
    return split.groupBy("file", "flag").agg(F.max_by("value", "line_no").alias("value"))


def pattern_rows(lines: DataFrame) -> DataFrame:
    """(line_no, line) -> (line_no, pattern): trimmed, without blank lines and ``#`` comments."""
    trimmed = lines.select("line_no", F.trim("line").alias("pattern"))
    return trimmed.filter("pattern <> '' and not startswith(pattern, '#')")
