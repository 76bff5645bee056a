"""Snapshots over time: replaying the log, merging segments, orphans, checks, and what is on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import code_times


def committed(log: DataFrame) -> DataFrame:
    """Inserts of ``log`` (ord, txn, op, key) that count: op is BEGIN, INSERT, COMMIT or ABORT.

    A BEGIN starts a new incarnation of its transaction; it counts if the first COMMIT or ABORT after
    it is a COMMIT, for inserts that lie between the two.
    """
    order = Window.partitionBy("txn").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = log.withColumn("incarnation", F.sum((F.col("op") == "BEGIN").cast("int")).over(order))
    ends = run.filter("incarnation > 0").groupBy("txn", "incarnation").agg(
        F.min(F.when(F.col("op") == "BEGIN", F.col("ord"))).alias("begins"),
        F.min(F.when(F.col("op").isin("COMMIT", "ABORT"), F.col("ord"))).alias("ends"),
        F.min(F.when(F.col("op") == "COMMIT", F.col("ord"))).alias("commits"),
    )
    ranges = ends.filter(F.col("ends") == F.col("commits"))
    inserts = run.filter(F.col("op") == "INSERT")
    inside = (F.col("ord") > F.col("begins")) & (F.col("ord") < F.col("ends"))
    return inserts.join(ranges, ["txn", "incarnation"]).filter(inside).select("ord", "txn", "key")


def orphans(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files (name) whose stem nothing refers to (stem)."""
    stem = F.regexp_extract("name", r"^(.*)\.(?:tri|old|wrd)$", 1)
    return files.withColumn("stem", stem).filter("stem <> ''").join(referenced, "stem", "left_anti").select("name")


def remap(documents: DataFrame) -> DataFrame:
    """(segment_id, local_id, new_id): dense ids over all segments, in order of segment and old id.

    Segments' sizes give the offsets, so ids are numbered within a segment only and no task orders
    all documents.
    """
    sizes = documents.groupBy("segment_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    offsets = sizes.select("segment_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("segment_id").orderBy("local_id")) - 1
    return documents.join(offsets, "segment_id").select("segment_id", "local_id", (F.col("offset") + rank).cast("long").alias("new_id"))


def merged(entries: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Postings or words (segment_id, local_id, key) under the new ids. The key may be the array of a
    document's keys: then a row for each document is joined, not one for each posting."""
    return entries.join(mapping, ["segment_id", "local_id"]).select(key, F.col("new_id").alias("local_id"))


def increasing(entries: DataFrame, key: str = "gram", doc: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., lists, entries, all_increasing): whether ids in every list only rise, once in order; so
    whether none stands there twice, which counts tell without putting a list in order."""
    pairs = entries.groupBy(*by, key, doc).agg(F.count("*").alias("times"))
    return _lists_rise(pairs, key, by)


def increasing_lists(entries: DataFrame, keys: str = "codes", doc: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The same of entries (by..., doc, keys) that hold a document's keys as an array of numbers: arrays
    are brought together by document, and no pair is shuffled."""
    arrays = entries.groupBy(*by, doc).agg(F.flatten(F.collect_list(keys)).alias("keys"))
    pairs = arrays.select(*by, F.explode(code_times(F.col("keys"))).alias("p")).select(*by, F.col("p.code").alias("key"), F.col("p.times").alias("times"))
    return _lists_rise(pairs, "key", by)


def _lists_rise(pairs: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """From (by..., key, times), a row for each document."""
    lists = pairs.groupBy(*by, key).agg(F.sum("times").alias("n"), (F.max("times") == 1).alias("rises"))
    whole = (F.count("*").alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries"), F.coalesce(F.bool_and("rises"), F.lit(True)).alias("all_increasing"))
    return lists.groupBy(*by).agg(*whole) if by else lists.agg(*whole)


def disk_usage(files: DataFrame, active: DataFrame) -> DataFrame:
    """files (name, bytes, allocated, dev, inode), active (stem) -> one row of bytes by kind.

    Parts of active segments count by kind; parts of other segments, and everything else, count
    apart. Allocated space of several links to one file counts once.
    """
    part = F.regexp_extract("name", r"^.*\.(tri|old|wrd)$", 1)
    stem = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    known = files.withColumn("part", part).withColumn("stem", stem).join(active.withColumn("is_active", F.lit(True)), "stem", "left")
    live = F.coalesce("is_active", F.lit(False))
    kinds = {"trigram": "tri", "word": "wrd", "legacy": "old"}
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("bytes"))), F.lit(0)).cast("long")
    sums = known.agg(
        *[total(live & (F.col("part") == ext)).alias(name) for name, ext in kinds.items()],
        total(~live & (F.col("part") != "")).alias("other"),
        total(F.col("part") == "").alias("auxiliary"),
        total(F.lit(True)).alias("logical"),
    )
    once = files.groupBy("dev", "inode").agg(F.max("allocated").alias("a"))
    once = once.agg(F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("allocated"))
    both = sums.unionByName(once, allowMissingColumns=True)  # a row of each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def inventory_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(path, digest) twice -> path, state: same, changed, added or removed."""
    b = baseline.select("path", F.col("digest").alias("was"))
    c = current.select("path", F.col("digest").alias("is_now"))
    state = (
        F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed")
        .when(F.col("was") == F.col("is_now"), "same").otherwise("changed")
    )
    return b.join(c, "path", "full").select("path", state.alias("state"))
