"""Operator 5: a quality classifier by nearest-neighbour voting.

A text's features are its byte trigrams, hashed, and a few shares (capitals, digits, symbols,
repeated words). A bounded sample of labelled rows gives the weights and a latent-semantic space (a
truncated singular value decomposition); the sample's vectors are broadcast. Every document is put
into that space, its cosines with all labelled vectors are computed block by block, and the labels of
its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample
from .textkernel import list_array, per_row, slices, words

BUCKETS, RANK, NEIGHBOURS, ROWS = 4096, 48, 15, 128
SHAPE_WEIGHT = 0.5
#: Cosines are compared in steps of this; equal ones go to the smaller doc_id.
STEP = 2.0**-20


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BUCKETS trigram counts, rows x 6 shares)."""
    n, lengths = len(offs) - 1, np.diff(offs)
    counts = np.zeros((n, BUCKETS), np.float64)
    if len(buf) >= 3:
        wide = buf.astype(np.uint32)
        key = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
        bucket = (key * np.uint32(0x9E3779B1)) >> np.uint32(20)
        row = np.repeat(np.arange(n), lengths)
        same = np.flatnonzero(row[:-2] == row[2:])
        at = row[same] * BUCKETS + bucket[same]
        counts = np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    size = np.maximum(lengths, 1)
    row, starts, ends, hashes = words(buf, offs, True)
    n_words = np.maximum(np.bincount(row, minlength=n), 1)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    symbol = ((buf > 32) & (buf < 48)) | ((buf > 57) & (buf < 65)) | ((buf > 90) & (buf < 97)) | ((buf > 122) & (buf < 128))
    shares = (
        per_row((buf >= 65) & (buf <= 90), offs) / size,
        per_row((buf >= 48) & (buf <= 57), offs) / size,
        per_row(symbol, offs) / size,
        1 - distinct / n_words,
        np.minimum(np.bincount(row, minlength=n) / 100, 1),
        np.minimum(size / n_words / 20, 1),
    )
    return counts, np.stack(shares, 1)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, buf, offs in slices(batch.column("text"), most_rows=ROWS):
            counts, shares = features(buf, offs)
            at, which = np.nonzero(counts)
            part = batch.slice(first, len(counts))
            bounds = np.searchsorted(at, np.arange(len(counts) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("label"),
                    list_array(which, bounds, pa.int32()),
                    list_array(counts[at, which].astype(np.int32), bounds, pa.int32()),
                    list_array(shares.ravel(), np.arange(len(shares) + 1) * shares.shape[1], pa.float64()),
                ],
                ["doc_id", "label", "at", "n", "shares"],
            )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class Space:
    """The latent-semantic space and the labelled vectors in it, which are in order of their doc_id."""

    def __init__(self, at: np.ndarray, times: np.ndarray, bounds: np.ndarray, shares: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Row i has times[bounds[i]:bounds[i + 1]] trigrams of the buckets at[...]; rows become dense by blocks only."""
        n = len(labels)

        def blocks():
            for i in range(0, n, ROWS):
                own = slice(bounds[i], bounds[min(n, i + ROWS)])
                counts = np.zeros((min(n, i + ROWS) - i, BUCKETS))
                counts[np.repeat(np.arange(len(counts)), np.diff(bounds[i : i + ROWS + 1])), at[own]] = times[own]
                yield i, counts

        self.idf = np.log((n + 1) / (np.bincount(at, minlength=BUCKETS) + 1)) + 1
        weighted = lambda counts: _unit(np.log1p(counts) * self.idf)
        # randomised range finder with three rounds of subspace iteration
        rng = np.random.default_rng(7)
        q = rng.standard_normal((BUCKETS, min(RANK + 16, n)))
        for _ in range(4):
            turned = np.zeros_like(q)
            for _, counts in blocks():
                x = weighted(counts)
                turned += x.T @ (x @ q)
            q, _ = np.linalg.qr(turned)
        _, _, small = np.linalg.svd(np.concatenate([weighted(counts) @ q for _, counts in blocks()]), full_matrices=False)
        self.axes = (q @ small.T)[:, :RANK]
        self.spread = shares.std(0) + 0.02
        self.mean = shares.mean(0)
        self.labels, self.weights = labels.astype(np.float64), weights.astype(np.float64)
        self.vectors = np.concatenate([self.place(counts, shares[i : i + ROWS]) for i, counts in blocks()])

    def place(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        latent = _unit((np.log1p(counts) * self.idf) @ self.axes)
        shape = np.clip((shares - self.mean) / self.spread, -4, 4) * SHAPE_WEIGHT
        return _unit(np.concatenate((latent, shape), 1))

    def vote(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        n = len(self.vectors)
        cosine = np.rint(self.place(counts, shares) @ self.vectors.T / STEP).astype(np.int64)
        k = min(NEIGHBOURS, n)
        rank = np.arange(n) - cosine * n  # no two are equal
        near = np.sort(np.partition(rank, k - 1, 1)[:, :k], 1) % n
        weight = np.maximum(np.take_along_axis(cosine, near, 1) * STEP, 1e-6) ** 4 * self.weights[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, in_training: Column, sample: int = 2048) -> Space | None:
    """The space of up to ``sample`` labelled rows of each label, chosen by hash of the id.

    A document's label is the mean of its rows in ``labels`` (doc_id, quality), rounded. The votes of
    a label are weighted by how many rows one sampled row stands for.
    """
    labels = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    training = docs.filter(in_training).select("doc_id").distinct().join(labels, "doc_id").select("doc_id", "label").persist()
    sizes = dict(training.groupBy("label").count().collect())
    if not sizes:
        training.unpersist()
        return None
    parts = [bounded_sample(training.filter(F.col("label") == x), sizes[x], sample, "doc_id") for x in sorted(sizes)]
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = chosen.collect()  # at most 2 * sample ids
    training.unpersist()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, label int")
    # of rows of one id the text that sorts first is learned from, and rows are in order of their ids,
    # so the space doesn't depend on how the table is partitioned
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = picked.mapInArrow(_sparse, "doc_id long, label int, at array<int>, n array<int>, shares array<double>").toArrow().sort_by("doc_id")
    at = got.column("at").combine_chunks()
    buckets, times = at.flatten().to_numpy(), got.column("n").combine_chunks().flatten().to_numpy()
    shares = got.column("shares").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    label = got.column("label").to_numpy()
    stands_for = {x: sizes[x] / max(1, int((label == x).sum())) for x in sizes}
    return Space(buckets, times, at.offsets.to_numpy(), shares, label, np.array([stands_for[x] for x in label.tolist()]))


def _vote(shared):
    def vote(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        space = shared.value
        for column in columns:
            scores = [np.zeros(0)]
            for _, buf, offs in slices(column, most_rows=ROWS):
                scores.append(space.vote(*features(buf, offs)) if space is not None else np.full(len(offs) - 1, 0.5))
            yield pa.array(np.clip(np.concatenate(scores), 0, 1), pa.float64())

    return vote


def score_quality(docs: DataFrame, labels: DataFrame, in_training: Column, sample: int = 2048, name: str = "quality_score") -> DataFrame:
    """``docs`` (doc_id, text) with a column ``name``, 0 to 1.

    Learned from labelled rows where ``in_training`` holds; without any, every score is 0.5. Null
    text is the empty text; both get the vote of the vectors nearest to a text of no trigrams. Null
    ids, repeated rows and very long texts (used whole) are scored like others. Of labelled vectors
    that are equally near, in steps of 2^-20, those of smaller doc_id vote. Scores don't depend on
    the partitioning. Other columns, of whatever name, pass through and never leave the JVM; a column
    called ``name`` is replaced. An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    space = fit(docs.select("doc_id", "text"), labels, in_training, sample)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    return docs.withColumn(name, F.arrow_udf(_vote(shared), "double")(docs["text"]))
