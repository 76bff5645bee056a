"""Operator 1: best-fit packing under conflicts.

Documents become pieces of at most ``capacity`` words. Pieces are dealt by hash to shards of bounded
size, and each shard is packed by best fit, longest first. Its open bins lie in order of what is
left in them; each carries one bitmap of the sources and one of the duplicate clusters it holds. The
search starts at the tightest bin that a piece fits into and goes on to the next until a bin has
neither the piece's source nor its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words

SCHEMA = "doc_id long, source string, piece int, first_word long, words long, bin_id long, bin_words long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """items: (size, source bit or -1, cluster bit or -1), longest first; each item's bin.

    Sizes lie in 1..capacity. A bin that is too full for the shortest item is closed.
    """
    least = items[-1][0] if items else 0
    open_bins: list[tuple[int, int]] = []  # (what is left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        own_source = 1 << source if source >= 0 else 0
        own_cluster = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (sources[b] & own_source or clusters[b] & own_cluster):
                break
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= own_source
        clusters[b] |= own_cluster
        out.append(b)
        if left - size >= least:
            insort(open_bins, (left - size, b))
    return out


def _pieces(doc_id, source, size: int, capacity: int):
    for piece, first in enumerate(range(0, size, capacity)):
        yield doc_id, source, piece, first, min(capacity, size - first)


def _pack_shard(capacity: int):
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "source", "copy"], kind="stable", na_position="last")
        source_bits = {s: i for i, s in enumerate(pdf["source"].dropna().unique())}
        seen = pdf["cluster"].value_counts()
        cluster_bits = {c: i for i, c in enumerate(sorted(seen.index[seen > 1]))}
        rows, empty = [], []
        for doc_id, source, size, cluster in zip(pdf["doc_id"], pdf["source"], pdf["size"], pdf["cluster"], strict=True):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            source = None if pd.isna(source) else source
            if not size:
                empty.append((doc_id, source, 0, 0, 0, None, None))
            for row in _pieces(doc_id, source, int(size), capacity):
                # two pieces of a long document belong to one cluster as well
                rows.append((row, source_bits.get(source, -1), cluster_bits.get(cluster, -1)))
        rows.sort(key=lambda r: -r[0][4])
        bins = best_fit([(row[4], s, c) for row, s, c in rows], capacity)
        filled: dict[int, int] = {}
        for (row, _, _), b in zip(rows, bins, strict=True):
            filled[b] = filled.get(b, 0) + row[4]
        first = int(key[0]) << 32
        packed = [(*row, first | b, filled[b]) for (row, _, _), b in zip(rows, bins, strict=True)]
        out = pd.DataFrame(packed + empty, columns=["doc_id", "source", "piece", "first_word", "words", "bin_id", "bin_words"])
        return out.astype({"doc_id": "Int64", "bin_id": "Int64", "bin_words": "Int64"})

    return pack


def pack_documents(docs: DataFrame, capacity: int = 2048, rows_per_shard: int = 4096) -> DataFrame:
    """Pack the words of ``docs`` (doc_id, text, source) into bins of ``capacity`` words.

    One row per piece: doc_id, source, piece, first_word and words (its span, in words), bin_id,
    bin_words (how full its bin is). A bin holds at most one piece of a source and at most one
    document of a duplicate cluster (documents of the same text). Documents of no words, or null,
    come back as one row without a bin. Documents of no source conflict by cluster only. Null ids
    are packed like others. Repeated rows are packed each, in different bins. Very long texts become
    many pieces, one bin each. Of pieces of equal length the one of smaller doc_id is placed first,
    and of equally full bins the one opened first is taken; reruns agree, whatever the partitioning.
    An empty table gives an empty table; other columns are ignored.

    Shards hold ``rows_per_shard`` documents on average at any input size, so the work of a task is
    bounded, and at most the last bins of each shard stay emptier than one packing of all would
    leave them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        F.md5(text.cast("binary")).alias("cluster"),
    )
    # rows that are equal are counted and numbered, so that a row repeated without end meets all shards
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    shards = max(1, -(-docs.count() // rows_per_shard))
    shard = F.pmod(F.xxhash64("doc_id", "source", "cluster", "copy"), F.lit(shards))
    return numbered.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack_shard(capacity), SCHEMA)
