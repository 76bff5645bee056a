"""Building the inverted index: documents in segments, postings, words, dictionaries, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import varint_length
from ..functions.text import gram_rows, token_rows

MAX_DOCUMENT = 64 << 20
SEGMENT_BYTES = 64 << 20
POSTING_BLOCK, WORD_BLOCK = 128, 512


def indexable(length: Column, head: Column) -> Column:
    """Documents over 64 MiB and those that begin with a UTF-16 byte-order mark are only scanned."""
    marks = [F.unhex(F.lit(m)) for m in ("FFFE", "FEFF")]
    return (length <= MAX_DOCUMENT) & ~F.substring(head, 1, 2).isin(*marks)


def assign_segments(docs: DataFrame, target: int = SEGMENT_BYTES, shards: tuple[str, ...] = ("root_id",)) -> DataFrame:
    """``docs`` (root_id, path, byte_length) with segment_no: a new segment for each ``target`` bytes.

    Bytes run by path within each of ``shards``, so no task holds the order of everything.
    """
    order = Window.partitionBy(*shards).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("byte_length").over(order), F.lit(0))
    return docs.withColumn("segment_no", F.floor(before / F.lit(target)).cast("long"))


def assign_ids(docs: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Dense local ids from 0 in each segment, in order of root and path."""
    order = Window.partitionBy(segment).orderBy("root_id", "path")
    return docs.withColumn("local_id", (F.row_number().over(order) - 1).cast("long"))


def postings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", once: bool | None = None) -> DataFrame:
    return gram_rows(docs, text, keep, once)


def word_entries(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", once: bool | None = None) -> DataFrame:
    return token_rows(docs, text, keep, once)


def dictionary(entries: DataFrame, key: str = "gram", by: tuple[str, ...] = ()) -> DataFrame:
    """How many documents have each key."""
    return entries.groupBy(*by, key).agg(F.count("*").alias("doc_freq"))


def posting_blocks(entries: DataFrame, key: str = "gram", doc: str = "doc_id", block: int = POSTING_BLOCK) -> DataFrame:
    """(key, block_no, n, max_id, encoded_bytes): lists in blocks, the first id of a block as it is and
    the others as differences, seven bits a byte. Lists are put in order once."""
    order = Window.partitionBy(key).orderBy(doc)
    placed = entries.select(key, doc, (F.row_number().over(order) - 1).alias("place"), F.lag(doc).over(order).alias("before"))
    delta = F.col(doc) - F.when(F.col("place") % block == 0, F.lit(0)).otherwise(F.coalesce("before", F.lit(0)))
    coded = placed.select(key, doc, F.floor(F.col("place") / block).cast("long").alias("block_no"), varint_length(delta).alias("bytes"))
    return coded.groupBy(key, "block_no").agg(
        F.count("*").alias("n"), F.max(doc).alias("max_id"), F.sum("bytes").cast("long").alias("encoded_bytes")
    )


def word_blocks(entries: DataFrame, shard: Column, block: int = WORD_BLOCK) -> DataFrame:
    """(shard, block_no, first_token, last_token, n): entries in order of token and document, in blocks.

    What a block holds follows from how many entries each token has, so entries are counted and not put
    in order. Tokens are, within a shard and their first three characters, which are in order before.
    """
    counts = entries.groupBy(shard.alias("shard"), "token").agg(F.count("*").alias("c"))
    counts = counts.withColumn("head", F.substring("token", 1, 3))
    above = [Window.unboundedPreceding, -1]
    heads = counts.groupBy("shard", "head").agg(F.sum("c").alias("c"))  # a row for each three characters
    before = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("head").rowsBetween(*above)), F.lit(0))
    heads = heads.select(F.col("shard").alias("s"), F.col("head").alias("h"), before.alias("before"))
    within = F.coalesce(F.sum("c").over(Window.partitionBy("shard", "head").orderBy("token").rowsBetween(*above)), F.lit(0))
    placed = counts.withColumn("within", within).join(heads, F.col("shard").eqNullSafe(F.col("s")) & F.col("head").eqNullSafe(F.col("h")))
    spans = placed.select("shard", "token", (F.col("before") + F.col("within")).alias("low"), (F.col("before") + F.col("within") + F.col("c")).alias("high"))
    each = spans.select("*", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")).alias("block_no"))
    n = F.least("high", (F.col("block_no") + 1) * block) - F.greatest("low", F.col("block_no") * block)
    return each.groupBy("shard", "block_no").agg(F.min("token").alias("first_token"), F.max("token").alias("last_token"), F.sum(n).alias("n"))


# Bytes of headers and fixed-width entries of the two file formats.
GRAM_FILE = {"header": 90, "document": 64, "path_byte": 2, "gram": 16, "block": 12}
WORD_FILE = {"header": 56, "block": 24, "entry": 12}


def gram_file_bytes(docs: Column, path_bytes: Column, grams: Column, blocks: Column, encoded: Column) -> Column:
    f = GRAM_FILE
    return f["header"] + f["document"] * docs + f["path_byte"] * path_bytes + f["gram"] * grams + f["block"] * blocks + encoded


def word_file_bytes(entries: Column) -> Column:
    f = WORD_FILE
    return f["header"] + f["block"] * F.ceil(entries / WORD_BLOCK) + f["entry"] * entries
