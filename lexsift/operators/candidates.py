"""Which documents the index leaves over, what that costs, and what has to be scanned besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_all_grams(postings: DataFrame, grams: tuple[str, ...], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents that have every gram. Postings are distinct, so a count is enough; the grams reach
    the scan as a pushed filter."""
    found = postings.filter(F.col("gram").isin(*grams)).groupBy(*by).count()
    return found.filter(F.col("count") == len(grams)).select(*by)


def with_token(words: DataFrame, token: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return words.filter(F.col("token") == token).select(*by).distinct()


def cost(dictionary: DataFrame, segments: DataFrame, grams: tuple[str, ...], segment: str = "segment_id") -> DataFrame:
    """One row: docs, source_bytes, and bound, how many candidates there can be at most.

    bound sums over segments the least document frequency of the grams, where a gram that a segment
    lacks counts as 0. ``segments`` has a row per segment: segment, docs, source_bytes.
    """
    wanted = dictionary.filter(F.col("gram").isin(*grams)).groupBy(segment).agg(
        F.min("doc_freq").alias("least"), F.count("*").alias("present")
    )
    joined = segments.join(wanted, segment, "left")
    least = F.when(F.col("present") == len(grams), F.col("least")).otherwise(F.lit(0))
    return joined.agg(
        F.sum("docs").cast("long").alias("docs"),
        F.sum("source_bytes").cast("long").alias("source_bytes"),
        F.coalesce(F.sum(least), F.lit(0)).cast("long").alias("bound"),
    )


def unchanged(indexed: DataFrame, live: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Keys whose recorded metadata equals the live metadata in every field."""
    return indexed.select(key, *fields).join(live.select(key, *fields), [key, *fields], "left_semi").select(key)


def to_scan(visible: DataFrame, named: DataFrame, covered: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of ``visible`` that are candidates or that the index can't answer for.

    ``named`` and ``covered`` have distinct keys, so each joins once and rows stay as they are: repeated
    ones are each kept, and one with a null in its key is never covered.
    """
    flags = covered.withColumn("is_covered", F.lit(True)).join(named.withColumn("is_named", F.lit(True)), list(key), "left")
    marked = visible.join(flags, list(key), "left")
    return marked.filter(F.col("is_covered").isNull() | F.col("is_named")).drop("is_covered", "is_named")


def scan_set(visible: DataFrame, candidates: DataFrame, covered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Visible candidates, and everything visible that the index can't answer for."""
    return to_scan(visible, candidates.select(key).distinct(), covered.select(key).distinct(), (key,))


def expand_aliases(canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every spelling under which a canonical path is visible, once each."""
    return aliases.join(canonical, "canonical", "left_semi").dropDuplicates(["display"])


def hinted_first(files: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """``files`` with ``hinted``, those of the hints first; a range sort, no order in one task."""
    marked = files.join(hints.select(F.col(key), F.lit(True).alias("hinted")).distinct(), key, "left")
    return marked.withColumn("hinted", F.coalesce("hinted", F.lit(False))).orderBy(F.desc("hinted"), key)


def positions(sorted_keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ordinal, key, position): where each wanted key stands, -1 if it doesn't; order and repeats stay."""
    return wanted.join(sorted_keys, "key", "left").select("ordinal", "key", F.coalesce("position", F.lit(-1)).cast("long").alias("position"))
