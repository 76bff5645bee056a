"""Operator 6: exact removal of repeated byte strings with suffix arrays.

Equal strings of LENGTH bytes have the same anchor: the least hash of the GRAM-byte strings in them.
Neighbouring strings mostly share it, so a document is cut into fragments, each with all the strings
of one anchor. Strings that repeat meet where their anchor meets. Fragments of equal content are
resolved to the earliest by fingerprint, and the different ones of an anchor are sorted: a two-stage
suffix array (suffixes smaller than their successors are sorted directly, the others follow from them
by scanning the buckets of first bytes), whose neighbours' common prefixes show every string that
repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, broadcast_if_small, materialize, number_rows
from .textkernel import BYTE_BITS, FOLDED_BITS, mix, slices, span_hashes

LENGTH, GRAM = 100, 32
#: Places of a gram in a string, less one.
REACH = LENGTH - GRAM
#: Strings of a fragment at most; only periodic text has longer runs of one anchor.
LONGEST = 128
#: Anchors that so many of SAMPLE rows have are dealt over SPLIT tasks first.
SAMPLE, OFTEN, SPLIT = 1 << 14, 64, 64


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every position, by doubling."""
    h, size = BYTE_BITS[buf], 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    return mix(h)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return x if size == width else pick(x[: len(x) - (width - size)], x[width - size :])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, anchor, whether strings may repeat within) of every run of neighbouring strings of one anchor.

    Strings are LENGTH bytes within a row, named by their starts; the anchor is the least hash of the
    grams in them. Each string is in one run, and runs are of at most LONGEST strings. Strings of one
    run can only be equal where the anchor stands twice in a row among the grams that are any
    string's least.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(bool)
    h = _gram_hashes(buf)
    least = _sliding(h, REACH + 1, np.minimum)
    for end in offs[1:-1].tolist():  # strings that reach into the next row are none
        least[max(0, end - LENGTH + 1) : end] = 0
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(first, len(least)))
    more = np.repeat(np.arange(len(first)), -(-size // LONGEST))
    step = np.arange(len(more)) - np.searchsorted(more, more)
    start = first[more] + step * LONGEST
    last = np.minimum(start + LONGEST, first[more] + size[more]) - 1
    real = least[start] > 0
    start, last = start[real], last[real]
    wide = np.zeros(len(least) + 2 * REACH, np.uint64)
    wide[REACH : REACH + len(least)] = least
    chosen = np.flatnonzero(_sliding(wide, REACH + 1, np.maximum)[: len(h)] == h)
    twice = chosen[:-1][h[chosen[1:]] == h[chosen[:-1]]]
    after = np.append(twice, len(h) + LENGTH)[np.searchsorted(twice, start)]
    return start, last, least[start], after <= last + REACH


def _anchors(shared):
    """Rows -> a row for each run of strings: 32 bits of its anchor, and the fragment of its bytes by
    hash and place. part is 0, or 1 and more for anchors that very many rows have."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for first, buf, offs in slices(batch.column("text"), 1 << 19):
                start, last, h, again = anchors(buf, offs)
                anchor = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = np.searchsorted(offs, start, "right") - 1
                rows = batch.slice(first, len(offs) - 1)
                row_id = rows.column("row_id").to_numpy()[row]
                deal = mix(row_id.astype(np.uint64) ^ (start - offs[row]).astype(np.uint64) << np.uint64(40)) % np.uint64(SPLIT)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        pa.array(np.where(np.isin(anchor, often), deal.astype(np.int32) + 1, 0).astype(np.int32)),
                        pa.array(span_hashes(buf, start, last + LENGTH).view(np.int64) if len(start) else np.zeros(0, np.int64)),
                        rows.column("doc_id").take(pa.array(row)),
                        pa.array(row_id),
                        pa.array((start - offs[row]).astype(np.int32)),
                        pa.array((last - start + LENGTH).astype(np.int32)),
                        pa.array(again),
                    ],
                    ["anchor", "part", "fragment", "doc_id", "row_id", "start", "size", "again"],
                )

    return found


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each row, once each."""
    for batch in batches:
        for _, buf, offs in slices(batch.column("text"), 1 << 19):
            start, _, h, _ = anchors(buf, offs)
            row = np.searchsorted(offs, start, "right") - 1
            pairs = np.unique(np.stack((row, (h >> np.uint64(32)).astype(np.int64))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype(np.uint32).view(np.int32))], ["anchor"])


def common_anchors(numbered: DataFrame, sample: int = SAMPLE, often: int = OFTEN) -> np.ndarray:
    """Anchors that at least ``often`` of ``sample`` rows, chosen by hash, have. They steer how rows are
    dealt and no result; there are at most as many as the sample's anchors over ``often``."""
    ids = [r["row_id"] for r in bounded_sample(numbered.select("row_id"), numbered.count(), sample, "row_id").collect()]
    chosen = numbered.sparkSession.createDataFrame([(i,) for i in ids], "row_id long")
    texts = numbered.select("row_id", "text").join(F.broadcast(chosen), "row_id", "left_semi").select("text")
    counts = texts.mapInArrow(_anchors_of, "anchor int").groupBy("anchor").count().filter(F.col("count") >= often)
    return np.sort(counts.select("anchor").toArrow().column("anchor").to_numpy())


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_id, doc_id, text and the wanted places (bucket, start, size) -> their bytes, a row each."""
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        wanted = batch.column("wanted")
        bounds = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        flat = wanted.flatten()
        bucket, start, size = (flat.field(c).to_numpy() for c in ("bucket", "start", "size"))
        row = np.repeat(np.arange(len(batch)), np.diff(bounds))
        for i in range(0, len(row), 1 << 16):
            rows, starts = row[i : i + (1 << 16)], start[i : i + (1 << 16)]
            pieces, last, raw = [], -1, b""
            for r, a, n in zip(rows.tolist(), starts.tolist(), size[i : i + (1 << 16)].tolist(), strict=True):
                if r != last:
                    raw, last = text[r].as_py(), r
                pieces.append(raw[a : a + n])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[i : i + (1 << 16)]),
                    pa.array(pieces, pa.binary()),
                    batch.column("doc_id").take(pa.array(rows)),
                    batch.column("row_id").take(pa.array(rows)),
                    pa.array(starts),
                ],
                ["bucket", "bytes", "doc_id", "row_id", "start"],
            )


def _words_at(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes at each position + depth as a big-endian number; text has room behind it."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | text[at + (depth + i)].astype(np.uint64)
    return out


def _direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes' first ``depth`` bytes, eight at a time: only those that
    are still tied go on."""
    order = np.argsort(_words_at(text, at, 0), kind="stable")
    at = at[order]
    key = _words_at(text, at, 0)
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = _words_at(text, at[tied], d)
        order = np.lexsort((key, group[tied]))
        at[tied], key = at[tied][order], key[order]
        new = np.zeros(len(at), np.int64)
        new[tied[1:]] = (group[tied][1:] == group[tied][:-1]) & (key[1:] != key[:-1])
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
    return at


def two_stage_suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (uint16 symbols under 257) in the order of their first ``depth`` symbols or more.

    A suffix is of kind B when it is smaller than its successor (the one a symbol further on). B
    suffixes are sorted directly. A suffix of the other kind, A, follows from its successor: buckets
    of first symbols are scanned from the smallest; as a bucket's suffixes stand in order, so do
    their predecessors of kind A, at the front of the buckets of their own first symbols.

    With ``wanted``, a flag for each position, only these suffixes come back (and those that follow
    on them up to the next of kind B, which they are induced from).
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # by the next symbol that differs; the end of the text is smaller than any symbol
    change = np.flatnonzero(text[1:] != text[:-1])
    following = np.searchsorted(change, np.arange(n))
    next_symbol = np.full(n, -1, np.int64)
    has = following < len(change)
    next_symbol[has] = text[change[following[has]] + 1]
    kind_b = text < next_symbol
    if wanted is None:
        wanted = np.ones(n, bool)
    else:  # as far as the next B
        ends = np.where(kind_b, np.arange(n), n)
        until = np.minimum.accumulate(ends[::-1])[::-1]
        edge = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, edge, 1)
        np.add.at(steps, np.minimum(until[edge], n - 1) + 1, -1)
        wanted = wanted | (np.cumsum(steps[:-1]) > 0)
    room = np.concatenate((text, np.zeros(depth + 16, text.dtype)))
    b = _direct_sort(room, np.flatnonzero(kind_b & wanted), depth)
    b = b[np.argsort(text[b], kind="stable")]
    b_bounds = np.searchsorted(text[b], np.arange(258))
    queue: list[list[np.ndarray]] = [[] for _ in range(257)]
    if wanted[n - 1]:
        queue[int(text[n - 1])].append(np.array([n - 1]))  # its successor is the empty suffix
    out = []
    for symbol in range(257):
        front = [q for q in queue[symbol] if len(q)]
        turn = np.concatenate(front) if front else np.zeros(0, np.int64)
        placed = []
        while len(turn):  # predecessors of the same symbol: they come behind, run by run
            placed.append(turn)
            before = turn[turn > 0] - 1
            turn = before[(text[before] == symbol) & wanted[before]]
        bucket = np.concatenate((*placed, b[b_bounds[symbol] : b_bounds[symbol + 1]]))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~kind_b[before] & wanted[before] & (text[before] > symbol)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)], strict=True) if len(cuts) else ():
            queue[int(first[a])].append(before[a:z])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How many symbols each suffix shares with the one before it, up to ``most``; 0 for the first."""
    out = np.zeros(len(at), np.int64)
    room = np.concatenate((text, np.zeros(most + 16, text.dtype)))
    alive = np.arange(1, len(at))
    for d in range(0, most, 8):
        a, b = _words_at(room, at[alive], d), _words_at(room, at[alive - 1], d)
        same = a == b
        out[alive[same]] += 8
        rest = alive[~same]
        for i in range(8):  # the first of the eight that differ
            ok = room[at[rest] + d + i] == room[at[rest - 1] + d + i]
            rest = rest[ok]
            out[rest] += 1
        alive = alive[same]
    return np.minimum(out, most)


def repeats_in(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, class) of every string of LENGTH bytes that stands in the pieces twice or more."""
    size = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    text = np.zeros(int(size.sum()) + len(pieces), np.uint16)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = data
    text += 1
    text[starts + size] = 0  # the pieces' ends, smaller than any byte
    full = np.arange(len(text)) + LENGTH <= np.repeat(starts + size, size + 1)
    order = two_stage_suffix_array(text, LENGTH + 4, full)
    piece = np.searchsorted(starts, order, "right") - 1
    keep = full[order]
    order, piece = order[keep], piece[keep]
    share = common_prefixes(text, order, LENGTH)
    same = share >= LENGTH
    member = same.copy()
    member[:-1] |= same[1:]
    return piece[member], (order - starts[piece])[member], np.cumsum(~same)[member]


def _runs(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that strings at these places cover, neighbours joined."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + 1)
    last = np.append(first[1:], True) if len(rows) else first
    return rows[first], starts[first], starts[last] + LENGTH


def _sort_bucket(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The fragments of one bucket -> runs of bytes whose strings stand earlier in the bucket. Where a
    hot anchor is split over buckets, also the strings that are first here, by digest."""
    split = bool(pdf["split"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "row_id", "start"], kind="stable", na_position="first")
    # of equal fragments all but the earliest go whole
    copy = pdf["bytes"].duplicated().to_numpy()
    copies, pdf = pdf[copy], pdf[~copy]
    pieces = list(pdf["bytes"])
    place, begin = pd.factorize(pdf["row_id"])[0], pdf["start"].to_numpy(np.int64)
    piece, offset, label = repeats_in(pieces)
    row, start = place[piece], begin[piece] + offset
    order = np.lexsort((start, row, label))  # rows are numbered in the order of their documents
    piece, offset, label, row, start = piece[order], offset[order], label[order], row[order], start[order]
    head = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))) if len(label) else np.zeros(0, np.int64)
    of = np.repeat(head, np.diff(np.append(head, len(label))))
    later = (row != row[of]) | (start != start[of])
    ids = pdf["row_id"].to_numpy(np.int64)
    run_row, run_start, run_end = _runs(ids[piece[later]], start[later])
    size = copies["bytes"].str.len().to_numpy(np.int64)
    long = size >= LENGTH
    copy_start = copies["start"].to_numpy(np.int64)[long]
    out = pd.DataFrame(
        {
            "row_id": np.concatenate((run_row, copies["row_id"].to_numpy(np.int64)[long])),
            "start": np.concatenate((run_start, copy_start)),
            "end": np.concatenate((run_end, copy_start + size[long])),
        }
    )
    if split and pieces:
        length = np.array([len(p) for p in pieces], np.int64)
        bounds = np.concatenate(([0], np.cumsum(length)))
        first = np.ones(int(bounds[-1]), bool)
        first[bounds[piece[later]] + offset[later]] = False
        of_piece = np.repeat(np.arange(len(pieces)), length)
        at = np.flatnonzero(first & (np.arange(len(first)) + LENGTH <= bounds[of_piece + 1]))
        of_piece = of_piece[at]
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        ask = pd.DataFrame(
            {
                "row_id": ids[of_piece],
                "start": begin[of_piece] + at - bounds[of_piece],
                "h1": span_hashes(buf, at, at + LENGTH).view(np.int64),
                "h2": span_hashes(buf, at, at + LENGTH, FOLDED_BITS[::-1]).view(np.int64),
                "doc_id": pdf["doc_id"].iloc[of_piece].to_numpy(),
            }
        ).drop_duplicates(["row_id", "start"])
        out = pd.concat((out, ask))
    return out.reindex(columns=["row_id", "start", "end", "h1", "h2", "doc_id"]).astype({c: "Int64" for c in ("end", "h1", "h2", "doc_id")})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's runs as few as can be: those that overlap or touch become one."""
    for batch in batches:
        runs = batch.column("runs")
        bounds = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        start, end = (runs.flatten().field(c).to_numpy() for c in ("start", "end"))
        row = np.repeat(np.arange(len(batch)), np.diff(bounds))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        # the furthest end so far, in each row: ends are raised by row so that one running maximum does
        lift = row * (int(end.max(initial=0)) + 1)
        reach = np.maximum.accumulate(end + lift) if len(end) else end
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | ((start + lift)[1:] > reach[:-1])
        last = np.append(first[1:], True) if len(row) else first
        offsets = np.searchsorted(row[first], np.arange(len(batch) + 1))
        spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array((reach - lift)[last])], ["start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["row_id", "runs"])


def _kept_sha256(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """SHA-256 of a text's bytes without its runs; null texts (those that lose nothing) have none."""
    for text, runs in texts:
        out = []
        for raw, spans in zip(text.cast(pa.binary()), runs, strict=True):
            raw, at = raw.as_py(), 0
            if raw is None:
                out.append(None)
                continue
            keep = hashlib.sha256()
            for r in spans.as_py():
                keep.update(raw[at : r["start"]])
                at = r["end"]
            keep.update(raw[at:])
            out.append(keep.hexdigest())
        yield pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, bucket_fragments: int = 2048, common: tuple[int, int] = (SAMPLE, OFTEN)) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every row of ``docs`` (doc_id, text).

    A byte is removed when a string of 100 bytes that covers it also starts earlier: in a smaller
    doc_id, or earlier in the same document. ``removed`` has the maximal removed runs (start, end) in
    bytes. Null text is the empty text; texts of fewer than 100 bytes lose nothing. A null doc_id
    comes before all others; rows of one doc_id follow each other in the order of their rows. Long
    texts count whole; other columns are ignored; an empty table gives an empty table.

    ``docs`` is read once.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = number_rows(given, "row_id", "repeats-input").select("row_id", "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(common_anchors(numbered, *common))
    schema = "anchor int, part int, fragment long, doc_id long, row_id long, start int, size int, again boolean"
    found = numbered.mapInArrow(_anchors(shared), schema)
    # one shuffle by anchor: equal fragments in order of place, how many there are, and how many differ
    place = (F.col("doc_id").asc_nulls_first(), "row_id", "start")
    order = Window.partitionBy("anchor", "part").orderBy("fragment", *place)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    new = F.coalesce(F.lag("fragment").over(order) != F.col("fragment"), F.lit(True))
    marked = found.withColumn("first", new).withColumn("n", F.count("*").over(whole)).filter("part > 0 or n > 1 or again")
    marked = marked.withColumn("kinds", F.sum(F.col("first").cast("int")).over(whole)).filter("part > 0 or kinds > 1 or again or not first")
    marked = materialize(marked.withColumn("fragment", F.when(F.col("part") > 0, F.col("fragment"))).drop("n"), "repeated-anchors")
    # of a common anchor, each part has found its own first fragments: at most SPLIT of a kind go on
    shown = ("anchor", "row_id", "start", "size", "again", "first", "kinds")
    order = Window.partitionBy("anchor", "fragment").orderBy(*place)
    firsts = marked.filter("part > 0 and first").withColumn("first", F.row_number().over(order) == 1).drop("kinds")
    firsts = materialize(firsts, "common-anchors")
    kinds = firsts.groupBy("anchor").agg(F.count_if("first").cast("long").alias("kinds"))
    firsts = firsts.join(F.broadcast(kinds), "anchor").select(*shown)  # a row for each common anchor, which are bounded
    marked = marked.filter("part = 0 or not first").select(*shown).unionByName(firsts)
    # of equal fragments all but the earliest go whole; different ones around an anchor are sorted
    copies = marked.filter("not first").select("row_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"))
    different = marked.filter("first and (kinds > 1 or again)")
    hot = max(2, bucket_fragments // 4)
    totals = different.agg(*[F.sum(F.when(c, 1)).alias(name) for name, c in (("cold", F.col("kinds") <= hot), ("hot", F.col("kinds") > hot))]).first()
    cold_buckets, hot_buckets = (max(1, -(-(totals[c] or 0) // bucket_fragments)) for c in ("cold", "hot"))
    part = F.pmod(F.xxhash64("row_id", "start"), F.ceil(F.col("kinds") / hot))
    cold = F.pmod(F.xxhash64("anchor"), F.lit(cold_buckets))
    bucket = F.when(F.col("kinds") <= hot, cold).otherwise(cold_buckets + F.pmod(F.xxhash64("anchor", part), F.lit(hot_buckets)))
    wanted = different.groupBy("row_id").agg(F.collect_list(F.struct(bucket.alias("bucket"), "start", "size")).alias("wanted"))
    cut = numbered.join(wanted, "row_id").mapInArrow(_fragments, "bucket long, bytes binary, doc_id long, row_id long, start int")
    cut = cut.withColumn("split", F.col("bucket") >= cold_buckets)
    runs = materialize(cut.groupBy("bucket").applyInPandas(_sort_bucket, "row_id long, start long, end long, h1 long, h2 long, doc_id long"), "repeated-runs")
    # strings around hot anchors that are first in their bucket: the earliest of all buckets stays
    order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_first(), "row_id", "start")
    asked = runs.filter("h1 is not null").withColumn("best", F.first(F.struct("row_id", "start")).over(order))
    asked = asked.filter(F.col("best") != F.struct("row_id", "start"))
    spans = runs.filter("h1 is null").select("row_id", "start", "end").unionByName(copies)
    spans = spans.unionByName(asked.select("row_id", "start", (F.col("start") + LENGTH).alias("end")))
    spans = spans.groupBy("row_id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    spans = materialize(spans.mapInArrow(_merge, "row_id long, runs array<struct<start:long,end:long>>"), "removed-runs")
    few = spans.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0] <= 500_000
    joined = numbered.join(broadcast_if_small(spans) if few else spans, "row_id", "left")
    # only texts that lose something go to Python
    cut_text = F.when(F.col("runs").isNotNull(), F.col("text"))
    shorter = F.arrow_udf(_kept_sha256, "string")(cut_text, F.coalesce("runs", F.array().cast("array<struct<start:long,end:long>>")))
    removed = F.coalesce("runs", F.array().cast("array<struct<start:long,end:long>>"))
    return joined.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"),
        F.when(F.col("runs").isNull(), F.sha2(F.col("text").cast("binary"), 256)).otherwise(shorter).alias("kept_sha256"),
        removed.alias("removed"),
    )
