"""Operator 9: quality rules, with a linear-chain conditional random field over lines.

Counts of words, symbols and repeats decide first. What passes is judged line by line: a
conditional random field of two labels, content and boilerplate, is decoded by Viterbi over the lines
that hold a word, and the share of words in content lines decides.

The field is trained here on a bounded sample of documents whose lines get weak labels (symbols, few
letters, capitals, exclamation marks, repeats within the document); its weights are drawn towards
plain prior weights, which hold alone where there is nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample
from .textkernel import IS_SPACE, list_array, mix, per_row, shingles, slices, span_hashes, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_byte = np.arange(256)
_IS_LETTER = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_IS_UPPER = (_byte >= 65) & (_byte <= 90)
_IS_DIGIT = (_byte >= 48) & (_byte <= 57)

FEATURES = ("bias", "symbols", "few letters", "capitals", "digits", "repeated", "short", "long words", "ends a sentence", "exclaims", "length")
#: Prior weights of the label boilerplate against content, and the transitions (from, to).
PRIOR = np.array([-1.5, 5.0, 6.0, 3.0, 4.0, 3.0, 0.5, 1.0, -0.5, 2.0, -3.0])
PRIOR_MOVES = np.array([[0.5, -0.5], [-0.5, 0.5]])


def repeated_words(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Words that lie in a window of three words which the row has twice or more."""
    _, value, at = shingles(rows, hashes, 3, short=False)
    key = value ^ mix(rows[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order) + 1, bool)
    twice[:-1][1:] |= same
    twice[: len(same)] |= same
    at = at[order[twice[:-1]]]
    covered = np.zeros(len(rows), bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(rows[covered], minlength=n_rows)


class Lines:
    """The lines with a word of a slice of documents: row, word count, hash, features."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, word_starts: np.ndarray):
        n_rows = len(offs) - 1
        breaks = np.flatnonzero(buf == 10)
        starts = np.sort(np.concatenate((offs[:-1], breaks + 1)))
        ends = np.sort(np.concatenate((breaks, offs[1:])))
        row = np.repeat(np.arange(n_rows), per_row(buf == 10, offs) + 1)
        n_words = np.bincount(np.searchsorted(starts, word_starts, "right") - 1, minlength=len(starts))
        self.all_rows, self.with_word = row, n_words > 0
        keep = np.flatnonzero(n_words)
        self.row, self.n_words, starts, ends = row[keep], n_words[keep], starts[keep], ends[keep]
        self.hash = span_hashes(buf, starts, ends)
        order = np.lexsort((self.hash, self.row))
        same = (self.row[order][1:] == self.row[order][:-1]) & (self.hash[order][1:] == self.hash[order][:-1])
        self.again = np.zeros(len(keep), bool)  # equal to an earlier line; which of the equals doesn't matter to counts
        self.again[order[1:][same]] = True
        self.repeated = self.again.copy()
        self.repeated[order[:-1][same]] = True
        ink = np.maximum(self._count(~IS_SPACE[buf], starts, ends), 1)
        share = lambda kind: self._count(kind[buf], starts, ends) / ink
        last = buf[np.maximum(ends - 1, starts)] if len(keep) else np.zeros(0, np.uint8)
        symbols, letters = share(_IS_SYMBOL), share(_IS_LETTER)
        self.features = np.stack(
            (
                np.ones(len(keep)),
                np.minimum(symbols / 0.1, 1),
                np.maximum(0, 0.7 - letters),
                share(_IS_UPPER) > 0.5,
                share(_IS_DIGIT),
                self.repeated,
                self.n_words < 4,
                np.minimum(np.maximum(ink / self.n_words - 12, 0) / 12, 1),
                np.isin(last, (33, 46, 63)),
                share(_byte == 33) > 0.05,
                np.minimum(self.n_words / 40, 1),
            ),
            1,
        ).astype(np.float64)

    @staticmethod
    def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[ends] - sums[starts]


def _chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, length) of each document's chain; the longest first, so that step t is a prefix."""
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(row)))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def viterbi(row: np.ndarray, score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (1: boilerplate) of chains of lines; score is that of boilerplate over content."""
    first, length = _chains(row)
    label = np.zeros(len(row), np.int8)
    if not len(row):
        return label
    back = np.zeros((len(row), 2), np.int8)
    best = np.stack((np.zeros(len(first)), score[first]), 1)
    for t in range(1, int(length[0])):
        alive = int(np.searchsorted(-length, -t, "left"))
        at = first[:alive] + t
        paths = best[:alive, :, None] + moves
        back[at] = paths.argmax(1)
        best[:alive] = paths.max(1)
        best[:alive, 1] += score[at]
    state = best.argmax(1).astype(np.int8)
    for t in range(int(length[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-length, -t, "left"))
        at = first[:alive] + t
        label[at] = state[:alive]
        if t:
            state[:alive] = back[at, state[:alive]]
    return label


def train_field(row: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 80, pull: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent on the chains' log likelihood (forward-backward),
    drawn to the prior. row: the document of each line, in order; y: weak labels."""
    weights, moves = PRIOR.copy(), PRIOR_MOVES.copy()
    first, length = _chains(row)
    if not len(row):
        return weights, moves
    joins = np.flatnonzero(row[1:] == row[:-1])
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[joins], y[joins + 1]), 1)
    seen = x[y == 1].sum(0)
    n = len(row)
    for _ in range(rounds):
        local = np.zeros((n, 2))
        local[:, 1] = x @ weights
        forward, backward = local.copy(), np.zeros((n, 2))
        steps = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]
        for t in range(1, len(steps)):
            at = first[: steps[t]] + t
            forward[at] += np.logaddexp.reduce(forward[at - 1][:, :, None] + moves, axis=1)
        for t in range(len(steps) - 1, 0, -1):
            at = first[: steps[t]] + t
            backward[at - 1] = np.logaddexp.reduce(moves + (local[at] + backward[at])[:, None, :], axis=2)
        whole = np.logaddexp.reduce(forward + backward, axis=1, keepdims=True)
        p = np.exp(forward + backward - whole)[:, 1]
        both = forward[joins][:, :, None] + moves + (local[joins + 1] + backward[joins + 1])[:, None, :]
        expected = np.exp(both - whole[joins][:, :, None]).sum(0)
        weights += 2.0 * ((seen - p @ x) / n - pull * (weights - PRIOR))
        moves += 2.0 * ((seen_moves - expected) / n - pull * (moves - PRIOR_MOVES))
    return weights, moves


def _sample_lines(most_lines: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            for first, buf, offs in slices(batch.column("text")):
                lines = Lines(buf, offs, words(buf, offs, False)[1])
                starts = np.searchsorted(lines.row, np.arange(len(offs)))
                spare = np.maximum(np.diff(starts) - most_lines, 0)
                begin = (mix(h[first : first + len(offs) - 1].view(np.uint64)) % (spare + 1).astype(np.uint64)).astype(np.int64)
                rank = np.arange(len(lines.row)) - (starts[:-1] + begin)[lines.row]
                keep = (rank >= 0) & (rank < most_lines)
                bounds = np.searchsorted(lines.row[keep], np.arange(len(offs)))
                part = batch.slice(first, len(offs) - 1)
                width = lines.features.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), list_array(lines.features[keep].ravel(), bounds * width, pa.float64())], ["h", "x"]
                )

    return sample


def fit(docs: DataFrame, sample: int = 2000, most_lines: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The field, from ``sample`` documents chosen by hash of id and text. A document of more than
    ``most_lines`` lines gives a stretch of so many, which may lie anywhere in its text; features are
    those of the whole document. Only hashes are put in order, and of equal rows one is taken."""
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    chosen = [r["h"] for r in bounded_sample(hashed.select("h").distinct(), docs.count(), sample, "h").collect()]
    picked = hashed.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")), "h").groupBy("h").agg(F.min("text").alias("text"))
    got = picked.mapInArrow(_sample_lines(most_lines), "h long, x array<double>").toArrow().sort_by("h")
    width = len(FEATURES)
    flat = got.column("x").combine_chunks()
    if not len(flat):
        return PRIOR.copy(), PRIOR_MOVES.copy()
    row = np.repeat(np.arange(got.num_rows), np.diff(flat.offsets.to_numpy()) // width)
    x = flat.flatten().to_numpy().reshape(len(row), width)
    symbols, few_letters, repeated = x[:, 1] >= 0.4, x[:, 2] > 0.2, x[:, 5] > 0
    capitals, exclaims = x[:, 3] > 0, x[:, 9] > 0
    y = (symbols | few_letters | repeated | capitals | exclaims).astype(np.int64)
    return train_field(row, x, y)


def _judge(shared, min_words: int, max_repeat_percent: int, min_content: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = shared.value
        for batch in batches:
            for first, buf, offs in slices(batch.column("text")):
                n = len(offs) - 1
                rows, starts, _, hashes = words(buf, offs, False)
                n_words = np.bincount(rows, minlength=n)
                repeat = repeated_words(rows, hashes, n)
                lines = Lines(buf, offs, starts)
                label = viterbi(lines.row, lines.features @ weights, moves)
                content = np.bincount(lines.row, lines.n_words * (label == 0), n) / np.maximum(n_words, 1)
                failed = (n_words < min_words) | (100 * repeat > max_repeat_percent * n_words)
                marks = np.full(len(lines.all_rows), ord("-"), np.uint8)
                marks[lines.with_word] = np.where(label, ord("B"), ord("C"))
                ends = np.cumsum(np.bincount(lines.all_rows, minlength=n))
                marks_of = [m.tobytes().decode() for m in np.split(marks, ends[:-1])]
                out = {
                    "n_words": n_words,
                    "word_chars": per_row(((buf & 0xC0) != 0x80) & ~IS_SPACE[buf], offs),
                    "n_symbols": per_row(_IS_SYMBOL[buf], offs),
                    "n_dup_lines": np.bincount(lines.row[lines.again], minlength=n),
                    "n_repeat_words": repeat,
                    "base_failed": failed,
                    "kept": ~failed & (content >= min_content),
                    "content_share": content,
                    "line_labels": marks_of,
                }
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out.values())], ["doc_id", *out])

    return judge


def apply_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.3, sample: int = 2000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share, and line_labels: one letter a line, C content, B boilerplate, - without a word.
    Null text is the empty text: no words, failed. Null ids, repeated rows and very long texts (used
    whole) are judged like others. Of equally good labellings a line's label is content, so ties are
    kept. Other columns are ignored; an empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample))
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double, line_labels string"
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(_judge(shared, min_words, max_repeat_percent, min_content), schema)
