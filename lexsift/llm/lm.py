"""Operator 4: language-model scoring by prediction by partial matching (PPM).

Training counts, over all training documents, are words (for a unigram base score) and byte strings
of ORDER + 1. The strings make a trie of contexts of 0 to ORDER bytes. A byte is predicted by its
longest context; where that has not seen it, an escape is coded and the next shorter context is
asked, without the bytes that the longer ones have already ruled out (symbol exclusion). Escapes are
estimated as half an event for every distinct byte of the context. A text's score is the log10
probability of its bytes and of its end.

Each document's bytes are looked up at once; only those that need an escape walk down the trie. Where
the trie is too large to be sent out, its lower orders and the most frequent strings of ORDER + 1 are,
and strings that these can't settle are settled, once each, by joins with the table of all strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import LOWER, Lookup, least_count, list_array, merge_counts, slices, words

ORDER = 5
#: Stands before the first and after the last byte of a text; no byte of UTF-8.
EDGE = 0xFF
#: Bytes that are worked on at once; they take about 100 times their size.
SLICE = 1 << 19
#: The hash that stands for the end token among word hashes.
END = np.uint64(0xE4D0FD0C5E4D0F17)

_models: dict[str, tuple] = {}


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every byte of every row and of its end; the key packs ORDER bytes before it and itself."""
    n_rows = len(offs) - 1
    lengths = np.diff(offs)
    padded = np.full(len(buf) + n_rows * (ORDER + 1), EDGE, np.uint64)
    row_of = np.repeat(np.arange(n_rows), lengths)
    padded[np.arange(len(buf)) + row_of * (ORDER + 1) + ORDER] = LOWER[buf]
    two = padded[:-1] << np.uint64(8) | padded[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    six = four[:-2] << np.uint64(16) | two[4:]
    # window i predicts byte i + ORDER; those that start in the last ORDER bytes of a row predict padding
    rows = np.repeat(np.arange(n_rows), lengths + ORDER + 1)[: len(six)]
    within = np.arange(len(six)) - (offs[:-1] + np.arange(n_rows) * (ORDER + 1))[rows]
    keep = within <= lengths[rows]
    return rows[keep], six[keep]


class _Counts:
    """Counts by key, merged now and then so that memory is bounded."""

    def __init__(self, most: int = 3 << 18):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, keys: np.ndarray) -> bool:
        """True if so many keys are held that they should be given out."""
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 2 * self.most:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])
        return self.held > self.most

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return merge_counts([k for k, _ in self.parts], [c for _, c in self.parts])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies = (_Counts(), _Counts())

    def give(kind: int):
        keys, counts = tallies[kind].merged()
        tallies[kind].parts, tallies[kind].held = [], 0
        for at in range(0, len(keys), 1 << 18):
            k = keys[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(counts[at : at + (1 << 18)])],
                ["kind", "key", "n"],
            )

    for batch in batches:
        for _, buf, offs in slices(batch.column("text"), SLICE):
            hashes = np.append(words(buf, offs, True)[3], np.full(len(offs) - 1, END))
            if tallies[0].add(hashes):
                yield from give(0)
            if tallies[1].add(grams(buf, offs)[1]):
                yield from give(1)
    yield from give(0)
    yield from give(1)


def walk(levels: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """log10 of strings from the longest context down, with escapes and exclusion."""
    out = np.zeros(len(keys))
    ruled_out = np.zeros((len(keys), 256), bool)
    todo = np.arange(len(keys))
    byte = (keys & np.uint64(255)).astype(np.int64)
    for order in range(ORDER, -1, -1):
        have, counts = levels[order]
        context = (keys[todo] >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
        low = np.searchsorted(have, context << np.uint64(8))
        high = np.searchsorted(have, (context << np.uint64(8)) | np.uint64(255), "right")
        n = high - low
        which = np.repeat(np.arange(len(todo)), n)
        at = np.arange(len(which)) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(todo) else which
        symbol = (have[at] & np.uint64(255)).astype(np.int64)
        c = counts[at] * ~ruled_out[todo[which], symbol]
        total = np.bincount(which, c, len(todo))
        kinds = np.bincount(which, c > 0, len(todo))
        own = np.bincount(which, c * (symbol == byte[todo[which]]), len(todo))
        seen = own > 0
        out[todo[seen]] += np.log10((2 * own[seen] - 1) / (2 * total[seen]))
        escapes = ~seen & (kinds > 0)
        out[todo[escapes]] += np.log10(kinds[escapes] / (2 * total[escapes]))
        ruled_out[todo[which], symbol] = True
        todo = todo[~seen]
    out[todo] -= np.log10(np.maximum(256 - ruled_out[todo].sum(1), 1))
    return out


class Trie:
    """Sorted keys and counts for each order, all of them; ``direct``: log10 of strings that need no escape."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], direct: tuple[np.ndarray, np.ndarray] | None = None):
        self.levels = levels
        if direct is None:
            keys, counts = levels[ORDER]
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            total = np.repeat(total, np.diff(np.append(first, len(keys))))
            direct = keys, np.log10((2 * counts - 1) / (2 * np.maximum(total, 1))).astype(np.float32)
        self.direct = Lookup(*direct)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        values, found = self.direct.find(keys)
        values = values.astype(np.float64)
        missing = np.flatnonzero(~found)
        if len(missing):
            distinct, back = np.unique(keys[missing], return_inverse=True)
            slow = np.concatenate([self.walk(distinct[i : i + 8192]) for i in range(0, len(distinct), 8192)])
            values[missing] = slow[back]
        return values

    def walk(self, keys: np.ndarray) -> np.ndarray:
        return walk(self.levels, keys)


def _direct(nodes: DataFrame) -> DataFrame:
    """(key, n, value): log10 of every string of ORDER + 1 that was seen, by exact totals."""
    own = nodes.filter(F.col("ord") == ORDER).select("key", "n", F.shiftright("key", 8).alias("context"))
    totals = own.groupBy("context").agg(F.sum("n").alias("total"))
    return own.join(totals, "context").select("key", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).cast("float").alias("value"))


def train(docs: DataFrame, max_nodes: int = 1 << 20, max_head: int = 200_000):
    """Count ``docs``' texts. Returns (vocabulary table, N, V, head words, trie levels, hot strings,
    table of all strings, table of their values).

    Counts cover all rows. ``max_nodes`` and ``max_head`` bound what is sent to executors and not
    the model: the orders from 0 up that have no more strings than that are whole trie levels. If
    these aren't all (else the last three are None), the most frequent strings of ORDER + 1 go with
    them, and all others stay in the tables; so do the words that aren't head words.
    """
    counted = docs.select("text").mapInArrow(_count, "kind byte, key long, n long")
    counts = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    vocabulary = counts.filter("kind = 0").select("key", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    histogram = [tuple(r) for r in vocabulary.groupBy("n").count().collect()]
    head = vocabulary.filter(F.col("n") >= least_count(histogram, max_head)).toArrow()
    suffixes = F.explode(F.array(*[F.struct(F.lit(j).alias("ord"), F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")) for j in range(ORDER + 1)]))
    nodes = counts.filter("kind = 1").select(suffixes.alias("s"), "n").groupBy("s.ord", "s.key").agg(F.sum("n").alias("n"))
    nodes = materialize(nodes, "lm-nodes")
    sizes = {r["ord"]: r["count"] for r in nodes.groupBy("ord").count().collect()}
    whole = next((j for j in range(ORDER + 1) if sizes.get(j, 0) > max_nodes), ORDER + 1)
    got = nodes.filter(F.col("ord") < whole).toArrow()
    ords, keys, ns = (got.column(c).to_numpy() for c in ("ord", "key", "n"))
    levels = []
    for j in range(whole):
        k, n = keys[ords == j].astype(np.uint64), ns[ords == j]
        order = np.argsort(k)
        levels.append((k[order], n[order]))
    hot = strings = None
    if whole <= ORDER:
        strings = materialize(_direct(nodes), "lm-strings")
        histogram = [tuple(r) for r in strings.groupBy("n").count().collect()]
        got = strings.filter(F.col("n") >= least_count(histogram, max_nodes)).select("key", "value").toArrow()
        hot = got.column("key").to_numpy().astype(np.uint64), got.column("value").to_numpy()
    head = head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy()
    return vocabulary, total, distinct, head, levels, hot, None if hot is None else nodes, strings


def _walker(shared):
    def walker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lower, _ = shared.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(at, 4096)
                ords, strings = batch.column("found").flatten().flatten()
                of = np.repeat(ords.to_numpy(), strings.value_lengths().to_numpy())
                keys, counts = (x.to_numpy() for x in strings.flatten().flatten())
                levels = list(lower)
                for j in range(len(lower), ORDER + 1):
                    have, first = np.unique(keys[of == j].astype(np.uint64), return_index=True)
                    levels.append((have, counts[of == j][first]))
                asked = batch.column("key")
                yield pa.RecordBatch.from_arrays([asked, pa.array(walk(levels, asked.to_numpy().astype(np.uint64)))], ["key", "value"])

    return walker


def _settle(asked: DataFrame, nodes: DataFrame, strings: DataFrame, shared, whole: int) -> DataFrame:
    """(key, value) of every distinct key of ``asked``: strings that were seen by a join, the others
    by walks over all strings of their contexts; orders below ``whole`` are in the broadcast."""
    placed = materialize(asked.select("key").distinct().join(strings.select("key", "value"), "key", "left"), "lm-asked")
    context = F.shiftright("key", 8)
    orders = [F.struct(F.lit(j).alias("ord"), context.bitwiseAND(F.lit((1 << 8 * j) - 1)).alias("context")) for j in range(whole, ORDER + 1)]
    requests = placed.filter("value is null").select("key", F.explode(F.array(*orders)).alias("r")).select("key", "r.ord", "r.context")
    contexts = nodes.filter(F.col("ord") >= whole).groupBy("ord", context.alias("context")).agg(F.collect_list(F.struct("key", "n")).alias("strings"))
    found = F.collect_list(F.when(F.col("strings").isNotNull(), F.struct("ord", "strings"))).alias("found")
    walked = requests.join(contexts, ["ord", "context"], "left").groupBy("key").agg(found).mapInArrow(_walker(shared), "key long, value double")
    seen = placed.filter("value is not null").select("key", F.col("value").cast("double").alias("value"))
    return materialize(seen.unionByName(walked), "lm-settled")


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, how often) of each row's distinct keys, by row."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(np.concatenate(([True], new))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.diff(np.append(first, len(rows)))


def _scorer(shared, name: str, total: int, distinct: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            (head_keys, head_counts), levels, hot = shared.value
            _models[name] = (Lookup(head_keys, head_counts), Trie(levels, hot))
        head, trie = _models[name]
        whole = len(trie.levels) > ORDER
        unit = np.log10(total + 0.5 * (distinct + 1))
        for batch in batches:
            for first, buf, offs in slices(batch.column("text"), SLICE, 8192):
                n = len(offs) - 1
                rows, _, _, hashes = words(buf, offs, True)
                counts, known = head.find(hashes)
                terms = np.log10(counts.astype(np.float64) + 0.5) - unit
                base = np.bincount(rows[known], terms[known], n)
                tail_offs = np.concatenate(([0], np.cumsum(np.bincount(rows[~known], minlength=n))))
                gram_rows, keys = grams(buf, offs)
                values, settled = (trie.log10(keys), np.ones(len(keys), bool)) if whole else trie.direct.find(keys)
                open_rows, open_keys, times = _distinct(gram_rows[~settled], keys[~settled])
                open_offs = np.concatenate(([0], np.cumsum(np.bincount(open_rows, minlength=n))))
                out = {
                    "n_words": np.bincount(rows, minlength=n).astype(np.int64),
                    "head_known": np.bincount(rows[known], minlength=n).astype(np.int64),
                    "head_score": base.astype(np.float64),
                    "score": np.bincount(gram_rows[settled], values[settled], n).astype(np.float64),
                }
                lists = {
                    "tail": list_array(hashes[~known].view(np.int64), tail_offs, pa.int64()),
                    "open": list_array(open_keys.view(np.int64), open_offs, pa.int64()),
                    "times": list_array(times, open_offs, pa.int64()),
                }
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_id"), *map(pa.array, out.values()), *lists.values()],
                    ["doc_id", "row_id", *out, *lists],
                )

    return score


def score_documents(docs: DataFrame, in_training: Column, max_nodes: int = 1 << 20, max_head: int = 200_000) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of the rows where ``in_training`` holds.

    One row per row: doc_id, n_tokens (words and one end), n_known (of those, seen in training),
    train_tokens, base_score (unigram, log10) and score (PPM, log10 probability of the text). Texts
    are lower-cased A-Z. Null text is the empty text, whose only token is the end. Without training
    rows the counts are 0 and every byte costs log10 of 1/256. Null ids, repeated rows and very long
    texts are scored like others; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("lm_train", F.coalesce(in_training, F.lit(False)))
    vocabulary, total, distinct, head, levels, hot, nodes, strings = train(docs.filter("lm_train"), max_nodes, max_head)
    ends = vocabulary.filter(F.col("key") == int(END.view(np.int64))).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((head, levels, hot))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), "text").mapInArrow(
        _scorer(shared, uuid.uuid4().hex, total, distinct),
        "doc_id long, row_id long, n_words long, head_known long, head_score double, score double, tail array<long>, open array<long>, times array<long>",
    )
    scored = materialize(scored, "lm-scored")
    unit = F.lit(float(np.log10(total + 0.5 * (distinct + 1))))
    tail = (
        scored.select("row_id", F.explode("tail").alias("key"))
        .join(vocabulary, "key", "left")
        .groupBy("row_id")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - unit).alias("tail_score"), F.count("n").alias("tail_known"))
    )
    open_score = F.lit(0.0)
    if nodes is not None:
        asked = scored.select("row_id", F.explode(F.arrays_zip("open", "times")).alias("o")).select("row_id", F.col("o.open").alias("key"), "o.times")
        settled = _settle(asked, nodes, strings, shared, len(levels))
        sums = asked.join(settled, "key").groupBy("row_id").agg(F.sum(F.col("value") * F.col("times")).alias("open_score"))
        scored, open_score = scored.join(sums, "row_id", "left"), F.coalesce("open_score", F.lit(0.0))
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))
    return scored.drop("tail", "open", "times").join(tail, "row_id", "left").select(
        "doc_id",
        (F.col("n_words") + 1).alias("n_tokens"),
        known.alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.5))) - unit).alias("base_score"),
        (F.col("score") + open_score).alias("score"),
    )
