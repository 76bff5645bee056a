"""Operator 10: n-gram Jaccard self-join by vertical partitioning, down to connected components.

A text's set is its distinct word shingles, as 64-bit hashes, in one global order: rare ones by hash,
then the frequent ones of the corpus by how many documents have them. The order is cut into fragments, so every set is
cut into segments; the overlap of two sets is counted segment by segment and summed per pair.

Pairs to count come from prefixes: sets of similarity t must share one of their first shingles. Two
documents of equal sets are one class, whatever their number. Groups of near copies are not expanded
into pairs either: in every prefix bucket the classes are first held against one pivot; when the
links found are closed to components, only pairs whose ends are still apart are counted. The
components are therefore those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, fresh_name, materialize, number_rows
from .components import connected_components
from .textkernel import distinct_sorted, least_count, list_array, merge_counts, mix, shingles, slices, words

FRAGMENTS = 8
LEAST_SEEN = 4
#: Bits of a set's sketch: each shingle turns over one bit. Sketches differ in no more bits than the
#: sets differ in shingles, which rules most pairs out before their segments are counted.
SKETCH = 1024
#: Sets of so many shingles have a wider sketch, which folds to the other size.
LARGE, WIDE_SKETCH = 1000, 4096
#: Buckets of more classes are joined in blocks of about so many.
BUCKET_BLOCK = 2048
#: The sketch folded to four numbers, which go with the bucket entries.
QUICK = 4


def _sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows, _, _, hashes = words(buf, offs, True)
    rows, hashes, _ = shingles(rows, hashes, k)
    return distinct_sorted(rows, hashes, len(offs) - 1)


def _frequent(k: int, least: int, held: int):
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lossy counting: when too many shingles are held, those seen once are let go."""
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, buf, offs in slices(batch.column("text")):
                new, times = np.unique(_sets(buf, offs, k)[0], return_counts=True)
                keys, counts = merge_counts([keys, new], [counts, times])
                if len(keys) > held:
                    keys, counts = keys[counts > 1], counts[counts > 1]
                    if len(keys) > held:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
                        keys, counts = keys[:0], counts[:0]
        often = counts >= least
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["key", "n"])

    return frequent


def frequent_shingles(docs: DataFrame, k: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` shingles that many documents have, sorted, and the place of each in the order of
    how many these are. Counts cover all documents; what a task saw fewer than four times is left out.
    Every document is put into the same order, so which shingles these are steers the work and not
    the result."""
    counts = docs.select("text").mapInArrow(_frequent(k, LEAST_SEEN, 1 << 19), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "jaccard-frequent")
    least = least_count([tuple(r) for r in counts.groupBy("n").count().collect()], most)
    got = counts.filter(F.col("n") >= least).toArrow()
    keys, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    place = np.empty(len(keys), np.int64)
    place[np.lexsort((keys, n))] = np.arange(1, len(keys) + 1)
    order = np.argsort(keys)
    return keys[order], place[order]


def _places(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for rare shingles, then by frequency."""
    keys, place = frequent
    if not len(keys):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, place[at], 0)


def _signatures(shared, k: int, num: int, den: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for first, buf, offs in slices(batch.column("text"), most_rows=256):
                values, bounds = _sets(buf, offs, k)
                n_rows, n = len(offs) - 1, np.diff(bounds)
                row = np.repeat(np.arange(n_rows), n)
                place = _places(values, frequent)
                order = np.lexsort((values, place, row))
                rank = np.arange(len(row)) - bounds[:-1][row]
                length = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                kept = rank < length[row]
                digest = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)))
                    digest.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                turned = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(WIDE_SKETCH)).astype(np.int64)
                odd = np.bincount(row * WIDE_SKETCH + turned, minlength=n_rows * WIDE_SKETCH).astype(np.uint8) & 1
                wide = np.packbits(odd).view(np.int64).reshape(n_rows, WIDE_SKETCH // 64)
                narrow = np.bitwise_xor.reduce(wide.reshape(n_rows, -1, SKETCH // 64), axis=1)
                parts = [w if large else s for w, s, large in zip(wide, narrow, n >= LARGE, strict=True)]
                sketch = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                ends = np.cumsum(np.where(n >= LARGE, WIDE_SKETCH // 64, SKETCH // 64))
                part = batch.slice(first, n_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_id"),
                        part.column("doc_id"),
                        pa.array(n.astype(np.int64)),
                        pa.array(np.bincount(row[place == 0], minlength=n_rows).astype(np.int64)),
                        *map(pa.array, digest),
                        list_array(values[order][kept].view(np.int64), np.concatenate(([0], np.cumsum(length))), pa.int64()),
                        list_array(sketch, np.concatenate(([0], ends)), pa.int64()),
                    ],
                    ["row_id", "doc_id", "n", "rare", "d1", "d2", "prefix", "sketch"],
                )

    return signatures


def _segments(shared, k: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for first, buf, offs in slices(batch.column("text")):
                values, bounds = _sets(buf, offs, k)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
                fragment = (values >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)
                fragment = np.where(_places(values, frequent) > 0, FRAGMENTS - 1, fragment.astype(np.int64))
                order = np.lexsort((values, fragment, row))
                key = row[order] * FRAGMENTS + fragment[order]
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                cid = batch.column("cid").slice(first, len(offs) - 1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cid[key[starts] // FRAGMENTS]),
                        pa.array((key[starts] % FRAGMENTS).astype(np.int32)),
                        list_array(values[order].view(np.int64), np.append(starts, len(key)), pa.int64()),
                    ],
                    ["cid", "fragment", "segment"],
                )

    return segments


def _count_overlaps(pairs: DataFrame, classes: DataFrame, numbered: DataFrame, shared, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are links; the sketches have been asked already."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    ids = materialize(ids.join(classes.select("cid", "row_id"), "cid"), "jaccard-needed")
    text = numbered.join(broadcast_if_small(ids), "row_id").select("cid", "text")
    segments = materialize(text.mapInArrow(_segments(shared, k), "cid long, fragment int, segment array<long>"), "jaccard-segments")
    left = segments.select(F.col("cid").alias("a"), "fragment", F.col("segment").alias("left"))
    right = segments.select(F.col("cid").alias("b"), "fragment", F.col("segment").alias("right"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("common"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.filter(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _need(num: int, den: int, n):
    """How many shingles a linked pair of ``n`` in both sets together has in common at least."""
    return F.ceil(n * F.lit(num) / F.lit(num + den) - F.lit(1e-9))


def _narrow(sketch):
    """A sketch in the smaller size."""
    words, step = WIDE_SKETCH // 64, SKETCH // 64
    folded = F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [F.get(sketch, F.lit(j)) for j in range(i, words, step)]) for i in range(step)])
    return F.when(F.size(sketch) == words, folded).otherwise(sketch)


def _may_differ(num: int, den: int, n):
    """In how many shingles the sets of a linked pair may differ at most."""
    return F.floor(n * F.lit(den - num) / F.lit(den + num) + F.lit(1e-9))


def _possible(num: int, den: int):
    """Size, position and sketch filters for x and y of one bucket: at the first shingle that linked
    sets share, both must have as many left, itself included, as they need to share; and their folded
    sketches differ in no more bits than the sets may in shingles."""
    need = _need(num, den, F.col("x.n") + F.col("y.n"))
    return (
        (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
        & (F.col("x.n") - F.col("x.pos") >= need)
        & (F.col("y.n") - F.col("y.pos") >= need)
        & (sum(F.bit_count(F.col(f"x.q{i}").bitwiseXOR(F.col(f"y.q{i}"))) for i in range(QUICK)) <= _may_differ(num, den, F.col("x.n") + F.col("y.n")))
    )


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = BUCKET_BLOCK) -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two rows are linked when ``den * intersection >= num * union`` of their sets of k-word shingles
    (A-Z folded; a text of fewer words has all of them as its one shingle). component_id is the
    smallest doc_id that links reach. Null, empty or blank texts have no shingles and link with
    nothing: their component is their own id. Null ids take part; a component of null ids only has
    a null id. Repeated rows are copies of each other like any others. Texts count whole. Other
    columns are ignored; an empty table gives an empty table.

    ``docs`` is read once; row_id is any number that no other row has.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _components(number_rows(given, "row_id", "jaccard-input"), k, num, den, block)


def _components(numbered: DataFrame, k: int, num: int, den: int, block: int = BUCKET_BLOCK) -> DataFrame:
    """The same of rows (row_id, doc_id, text) that have been written."""
    bound_batches(numbered.sparkSession)
    shared = numbered.sparkSession.sparkContext.broadcast(frequent_shingles(numbered, k))
    schema = "row_id long, doc_id long, n long, rare long, d1 long, d2 long, prefix array<long>, sketch array<long>"
    signed = materialize(numbered.mapInArrow(_signatures(shared, k, num, den), schema), "jaccard-signatures")
    classes = signed.filter("n > 0").groupBy("n", "rare", "d1", "d2").agg(F.min("doc_id").alias("least"), F.min("row_id").alias("row_id"))
    # numbered by how few rare shingles they have: the smallest number of a bucket is its most central class
    classes = materialize(classes.orderBy("rare").withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    numbers = classes.select("cid", F.col("n").cast("int").alias("n"), "row_id")
    sketches = materialize(signed.select("row_id", "sketch").join(numbers, "row_id").select("cid", "sketch"), "jaccard-sketches")

    # prefix buckets with two classes or more; pos is the place of the bucket's shingle in the set
    prefixes = signed.select("row_id", "prefix").join(numbers, "row_id")
    entries = prefixes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    # of a pair, the set that isn't longer has the bucket's shingle in the first half of its prefix
    first_half = F.col("n") - F.col("pos") >= _need(num, den, 2 * F.col("n"))
    pivots = entries.groupBy("token").agg(F.min("cid").alias("pivot"), F.count("*").alias("classes"), F.bool_or(first_half).alias("open"))
    blocks = F.ceil(F.col("classes") / block).cast("int")
    pivots = pivots.filter("classes > 1 and open").select("token", "pivot", blocks.alias("blocks"))
    folded = [reduce(lambda a, b: a.bitwiseXOR(b), [F.col("narrow")[j] for j in range(i, SKETCH // 64, QUICK)]).alias(f"q{i}") for i in range(QUICK)]
    buckets = materialize(entries.join(pivots, "token").join(sketches.withColumn("narrow", _narrow(F.col("sketch"))).select("cid", *folded), "cid"), "jaccard-buckets")

    def similar(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches differ in no more bits than linked sets may differ in shingles."""
        for side in "ab":
            pairs = pairs.join(sketches.select(F.col("cid").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
        same = F.size("sketch_a") == F.size("sketch_b")
        sides = [F.when(same, F.col(c)).otherwise(_narrow(F.col(c))) for c in ("sketch_a", "sketch_b")]
        bits = F.aggregate(F.zip_with(*sides, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return pairs.filter(bits <= _may_differ(num, den, F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")

    def ordered(candidates: DataFrame) -> DataFrame:
        return candidates.select(
            F.least("x.cid", "y.cid").alias("a"),
            F.greatest("x.cid", "y.cid").alias("b"),
            F.when(F.col("x.cid") < F.col("y.cid"), F.col("x.n")).otherwise(F.col("y.n")).alias("na"),
            F.when(F.col("x.cid") < F.col("y.cid"), F.col("y.n")).otherwise(F.col("x.n")).alias("nb"),
        ).distinct()

    centre, rest = buckets.filter("cid = pivot").alias("x"), buckets.filter("cid <> pivot").alias("y")
    stars = materialize(similar(ordered(rest.join(centre, "token").filter(_possible(num, den)))), "jaccard-stars")
    links = materialize(_count_overlaps(stars, classes, numbered, shared, k, num, den), "jaccard-star-links")
    roots = materialize(connected_components(links), "jaccard-roots")

    # what the pivots left apart: one end outside of the pivot's component, the other anywhere else
    rooted = broadcast_if_small(roots.select(F.col("node").alias("cid"), "root"))
    pivot_rooted = broadcast_if_small(roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")))
    placed = buckets.join(rooted, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = placed.join(pivot_rooted, "pivot", "left")
    placed = placed.withColumn("outside", F.col("root") != F.coalesce("pivot_root", "pivot"))
    placed = materialize(placed.select("token", "cid", "n", "pos", "root", "outside", "blocks", *[f"q{i}" for i in range(QUICK)]), "jaccard-placed")
    once = ~F.col("y.outside") | (F.col("x.cid") < F.col("y.cid"))
    # a large bucket is many joins: its outside classes are dealt to blocks, the others meet every block
    dealt = placed.filter("outside").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = dealt.alias("x").join(met.alias("y"), ["token", "block"])
    found = found.filter((F.col("x.root") != F.col("y.root")) & once & _possible(num, den))
    pairs = materialize(similar(ordered(found)).join(stars.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
    more = _count_overlaps(pairs, classes, numbered, shared, k, num, den)
    everything = materialize(links.unionByName(more), "jaccard-links")
    roots = connected_components(everything).withColumnRenamed("node", "cid")
    roots = materialize(classes.select("cid", "least").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "jaccard-components")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    component = roots.join(ids, "root").join(classes.select("cid", "n", "d1", "d2"), "cid").select("n", "d1", "d2", "component_id")
    joined = signed.drop("prefix", "sketch").join(component, ["n", "d1", "d2"], "left")
    return joined.select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (of equal ids, the first).

    A row without shingles (null, empty or blank text), or with no id in its component, counts as a
    component of its own. Repeated rows are copies, so one stays. Texts count whole; columns of any
    name pass through; an empty table gives an empty table.
    """
    row = fresh_name(docs, "jaccard_row")
    numbered = number_rows(docs, row, "jaccard-input")
    given = numbered.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(_components(given, k, num, den), "jaccard-found")
    alone = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    leaders = found.filter(~alone & (F.col("doc_id") == F.col("component_id"))).groupBy("component_id").agg(F.min("row_id").alias("row_id"))
    dropped = materialize(found.filter(~alone).select("row_id").join(leaders.select("row_id"), "row_id", "left_anti"), "jaccard-dropped")
    gone = broadcast_if_small(dropped.select(F.col("row_id").alias(row)))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
