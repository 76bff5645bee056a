"""The cache of query results: keys are pattern, flags and generation; values are document ids.

Hits are hints for the order of work, never the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("pattern", "flags", "generation")


def status(cache: DataFrame, generation: int) -> DataFrame:
    """One row: entries, file_refs, stale (of another generation)."""
    return cache.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.size("file_ids")), F.lit(0)).cast("long").alias("file_refs"),
        F.count_if(F.col("generation") != generation).alias("stale"),
    )


def listing(cache: DataFrame, most: int = 50) -> DataFrame:
    """The first entries in order of insertion (cached_at, then key)."""
    return cache.select(*KEY, F.size("file_ids").alias("files"), "cached_at").orderBy("cached_at", *KEY).limit(most)


def compact(cache: DataFrame, generation: int) -> DataFrame:
    return cache.filter(F.col("generation") == generation)


def lookup(cache: DataFrame, documents: DataFrame, pattern: str, flags: int, generation: int) -> DataFrame:
    """Paths of one entry, or nothing at all if one of its ids isn't in ``documents`` (file_id, path)."""
    entry = cache.filter((F.col("pattern") == pattern) & (F.col("flags") == flags) & (F.col("generation") == generation))
    resolved = resolve(entry, documents)
    return resolved.filter("complete").select(F.explode("paths").alias("path"))


def resolve(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """Each entry with its paths in order and whether all ids have one."""
    ids = cache.select(*KEY, F.posexplode_outer("file_ids").alias("at", "file_id"))
    joined = ids.join(documents.select("file_id", "path"), "file_id", "left")
    grouped = joined.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("at", "path")))).alias("found"),
        F.bool_and(F.col("path").isNotNull() | F.col("at").isNull()).alias("complete"),
    )
    return grouped.select(*KEY, F.transform("found", lambda x: x["path"]).alias("paths"), "complete")


def migrate(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """One-row-per-path entries (key, file_path, cached_at) -> (key, file_id, cached_at), a row for each
    file of a key; a path that no longer resolves drops its whole key. No entry becomes one long array."""
    joined = rows.join(documents.select(F.col("path").alias("file_path"), "file_id"), "file_path", "left")
    keys = joined.groupBy(*KEY).agg(F.bool_and(F.col("file_id").isNotNull()).alias("complete"), F.max("cached_at").alias("cached_at"))
    return joined.select(*KEY, "file_id").distinct().join(keys.filter("complete").drop("complete"), list(KEY))


def enumerate_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias("file_count"))


def store(cache: DataFrame, entry: DataFrame) -> DataFrame:
    """``cache`` with the entries of ``entry`` in place of those of the same keys; an entry whose ids
    are null (incomplete) only takes the old one out."""
    kept = cache.join(entry.select(*KEY), list(KEY), "left_anti")
    return kept.unionByName(entry.filter(F.col("file_ids").isNotNull()).select(*cache.columns))


def invalidate(rows: DataFrame, pattern: str, flags: int) -> DataFrame:
    """Rows without those of one pattern and flags, of any generation."""
    return rows.filter(~((F.col("pattern") == pattern) & (F.col("flags") == flags)))


def evict_oldest(cache: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` entries; what goes first is oldest."""
    return cache.orderBy(F.desc("cached_at"), *KEY).limit(capacity)


def warm_variants(patterns: DataFrame, insensitive: bool, word: bool) -> DataFrame:
    """Each pattern as it is, and with -i and -w where asked: (pattern, flags)."""
    flags = [0, *([1] if insensitive else []), *([2] if word else [])]
    return patterns.select("pattern", F.explode(F.array(*map(F.lit, flags))).alias("flags"))
