"""Operator 8: language identification by mixture inference.

Every language has a distribution over hashed byte trigrams, counted over all training documents. A
document is taken to be a mixture of languages: expectation maximisation estimates the proportions
from its trigrams' likelihoods. Sets of one, two, ... languages are compared by their likelihood less
half a log of the document's trigrams for each further proportion, and the best set is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import slices

BITS = 16
#: Languages whose counts a task holds, or the driver fetches, at once.
HELD = 64
#: Letters stay (bytes of other scripts as they are, A-Z folded); all else is a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every trigram that holds a letter; a text begins and ends with spaces."""
    n_rows, lengths = len(offs) - 1, np.diff(offs)
    row_of = np.repeat(np.arange(n_rows), lengths)
    padded = np.full(len(buf) + 2 * n_rows + 2, 32, np.uint32)
    padded[np.arange(len(buf)) + 2 * row_of + 2] = _LETTER[buf]
    key = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    # two spaces stand before each row and after the last: window i ends at the byte i + 2, and a
    # window over a row's end and its two spaces counts for the row
    row = np.repeat(np.arange(n_rows), lengths + 2)
    keep = np.flatnonzero(key[: len(row)] != 0x202020)
    bucket = (key[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return row[keep], bucket.astype(np.int64)


def _count(most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def give():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"]
                )
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, buf, offs in slices(batch.column("text")):
                row, bucket = trigrams(buf, offs)
                own = np.array(langs[first : first + len(offs) - 1], object)
                names, codes = np.unique(own.astype(str), return_inverse=True)
                for code, lang in enumerate(names.tolist()):
                    got = np.bincount(bucket[codes[row] == code], minlength=1 << BITS)
                    held[lang] = held[lang] + got if lang in held else got
                if len(held) > most:
                    yield from give()
        yield from give()

    return count


def train(docs: DataFrame, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages in order, log likelihood of each bucket in each).

    Counts cover all rows of ``docs`` (text, lang), and every lang value is a language of the model,
    which takes 256 KB for each.
    """
    counts = docs.select("text", "lang").mapInArrow(_count(HELD), "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    table = np.empty((1 << BITS, len(langs)), np.float32)
    for first in range(0, len(langs), HELD):
        some = langs[first : first + HELD]
        got = counts.filter(F.col("lang").isin(some)).toArrow()
        place = {lang: i for i, lang in enumerate(some)}
        columns = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
        part = np.full((1 << BITS, len(some)), smoothing)
        np.add.at(part, (got.column("bucket").to_numpy(), columns), got.column("n").to_numpy())
        table[:, first : first + len(some)] = np.log(part / part.sum(0))
    counts.unpersist()
    return langs, table


def _mixture(likelihood: np.ndarray, counts: np.ndarray, starts: np.ndarray, row: np.ndarray, share: np.ndarray, turns: int) -> np.ndarray:
    total = np.add.reduceat(counts, starts)[:, None]
    for _ in range(turns):
        joint = likelihood * share[row]
        joint *= (counts / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    return share


def proportions(row: np.ndarray, bucket: np.ndarray, n_rows: int, table: np.ndarray, turns: int = 12) -> np.ndarray:
    """Each row's language proportions (rows of no trigrams: all 0).

    Sets take languages in order of their share in the mixture of all. They grow as long as a bound
    on the likelihood of any mixture leaves room for a better one.
    """
    n_langs = table.shape[1]
    out = np.zeros((n_rows, n_langs))
    if not len(row) or not n_langs:
        return out
    keys, counts = np.unique(row << BITS | bucket, return_counts=True)
    row, bucket = keys >> BITS, keys & ((1 << BITS) - 1)
    present, starts = np.unique(row, return_index=True)
    row = np.repeat(np.arange(len(present)), np.diff(np.append(starts, len(row))))
    counts = counts.astype(np.float64)
    log = table[bucket].astype(np.float64)
    top = log.max(1)
    likelihood = np.exp(log - top[:, None])
    single = np.add.reduceat(log * counts[:, None], starts, axis=0)
    best = single.argmax(1)
    score = single.max(1)
    chosen = np.eye(n_langs)[best]
    if n_langs > 1:
        offset, total = np.add.reduceat(top * counts, starts), np.add.reduceat(counts, starts)
        penalty = np.log(np.maximum(total, 2)) / 2
        full = _mixture(likelihood, counts, starts, row, np.full((len(present), n_langs), 1 / n_langs), turns)
        order = np.argsort(-full, axis=1, kind="stable")
        # no mixture is likelier than this one by more than log of its largest gradient a trigram (Jensen)
        mixed = (likelihood * full[row]).sum(1)
        slope = np.add.reduceat(likelihood * (counts / mixed)[:, None], starts, axis=0).max(1) / total
        bound = np.add.reduceat(np.log(mixed) * counts, starts) + offset + total * np.log(np.maximum(slope, 1))
        lengths = np.diff(np.append(starts, len(row)))
        for size in range(2, n_langs + 1):
            left = bound - (size - 1) * penalty > score
            rows, at = np.flatnonzero(left), np.flatnonzero(left[row])
            if not len(rows):
                break
            own, own_starts = np.repeat(np.arange(len(rows)), lengths[rows]), np.cumsum(lengths[rows]) - lengths[rows]
            langs = order[rows, :size]
            part = likelihood[at[:, None], langs[own]]
            share = np.take_along_axis(full[rows], langs, 1) + 1e-9
            share = _mixture(part, counts[at], own_starts, own, share / share.sum(1, keepdims=True), turns // 2)
            mixed = np.add.reduceat(np.log((part * share[own]).sum(1)) * counts[at], own_starts) + offset[rows] - (size - 1) * penalty[rows]
            better = mixed > score[rows]
            score[rows[better]] = mixed[better]
            chosen[rows[better]] = 0
            chosen[rows[better][:, None], langs[better]] = share[better]
    out[present] = chosen
    return out


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = (_LETTER[buf] != 32) & (buf < 128)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, buf[offs[i] : offs[i + 1]].tobytes().decode()))
    return out


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            for first, buf, offs in slices(batch.column("text"), min(1 << 20, (1 << 23) // max(1, len(langs)))):
                row, bucket = trigrams(buf, offs)
                share = proportions(row, bucket, len(offs) - 1, table)
                known = _has_letter(buf, offs) & (share.sum(1) > 0) if langs else np.zeros(len(offs) - 1, bool)
                best = share.argmax(1) if langs else np.zeros(len(offs) - 1, int)
                score = np.where(known, share.max(1) if langs else 0.0, 0.0)
                mixes = [
                    [{"lang": langs[j], "share": float(min(1.0, s[j]))} for j in np.argsort(-s, kind="stable") if s[j] > 0] if k else []
                    for s, k in zip(share, known, strict=True)
                ]
                part = batch.slice(first, len(offs) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                        pa.array(mixes, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    return predict


def identify_languages(docs: DataFrame, in_training: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, lang_pred, score, languages.

    Trained on the rows with a lang where ``in_training`` holds. ``languages`` has the chosen set
    with its proportions, lang_pred is the largest and score its proportion. ``und`` with score 0:
    null text, text without a letter, or nothing learned. Equal likelihoods go to the language that
    sorts first. Null ids and repeated rows are scored like others, other columns are ignored, an
    empty table gives an empty table; texts are used whole.
    """
    langs, table = train(docs.filter(F.coalesce(in_training, F.lit(False)) & F.col("lang").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predict(shared), "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )
