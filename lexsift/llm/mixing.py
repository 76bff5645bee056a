"""Operator 7: mixing sources to target weights by hash-threshold histograms.

Every document has a 36-bit hash. Words are summed by source and by the upper 12 bits; the bucket in
which a source's budget ends is the only one that is looked at again, by its next 12 bits, and then
once more. What remains is one threshold per source, and the mix is a filter: nothing is sorted, and
the same rows always give the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, n_words

BITS, LEVELS = 12, 3


def mix_hash(doc_id, text):
    """36 bits of an MD5 over id and text: alike on every engine and in every run."""
    whole = F.md5(
        F.concat(
            F.coalesce(doc_id.cast("string"), F.lit("")),
            F.lit(":"),
            F.md5(F.coalesce(text, F.lit("")).cast("binary")),
        ).cast("binary")
    )
    return F.conv(F.substring(whole, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size) -> the same with target, copies (whole passes) and budget (the rest).

    Sources by code point, null last, take the weights in turn. Shares stop at ``max_repeat`` times
    the source's size; what they leave is shared again by weight until none is above. Written as
    water filling: in order of cap over weight, a source is full when its cap is not above its share
    of what the fuller ones left. One row per source, so the global order is over a small table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    ).cast("double")
    cap = F.col("source_size").cast("double") * max_repeat
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(0, Window.unboundedFollowing)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.col("full_before")) / F.col("weight_from")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(after))
        .withColumn("level", F.when(F.col("cap") > level * F.col("weight"), level))
        .withColumn("level", F.first("level", ignorenulls=True).over(whole))
        .withColumn(
            "target",
            F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))),
        )
        .withColumn(
            "copies",
            F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat)))
            .otherwise(F.lit(0)).cast("long"),
        )
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("source", "source_size", "target", "copies", "budget")
    )


def mix_thresholds(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, copies, threshold.

    ``docs`` has doc_id, text and source. A document is taken ``copies`` times, and once more when
    its hash is below ``threshold``. At the last level the bucket is taken when that lands nearer
    the budget, so a source misses its target by half of its largest document at most (documents
    that share all 36 bits, such as repeated rows, go together).
    """
    sized = docs.select("source", n_words(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("h"))
    sized = materialize(sized, "mix-sizes")
    sources = materialize(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat), "mix-sources"
    )
    # bounds: the hash prefix at which the budget ends, and how much of the budget is left there
    bounds = sources.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        shift, last = BITS * (LEVELS - 1 - level), level == LEVELS - 1
        inside = sized.withColumn("at", F.shiftrightunsigned("h", shift))
        if level:
            edge = broadcast_if_small(bounds).alias("b")
            inside = inside.alias("s").join(
                edge,
                F.col("s.source").eqNullSafe(F.col("b.source"))
                & (F.shiftrightunsigned("s.h", shift + BITS) == F.col("b.prefix")),
                "left_semi",
            )
        sums = inside.groupBy("source", "at").agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("words").over(running)).alias("s")
        ended = (
            sums.join(broadcast_if_small(bounds).alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")))
            .filter(F.col("upto") > F.col("left"))
            .groupBy("b.source")
            .agg(
                F.min(F.struct("at", "upto", "words", "left")).alias("m")
            )
        )
        if last:
            rest = F.col("m.left") - (F.col("m.upto") - F.col("m.words"))
            take = (rest * 2 > F.col("m.words")).cast("long")
            ended = ended.select("source", (F.col("m.at") + take).alias("threshold"))
        else:
            ended = ended.select(
                "source",
                F.col("m.at").alias("prefix"),
                (F.col("m.left") - (F.col("m.upto") - F.col("m.words"))).alias("left"),
            )
        bounds = materialize(ended, f"mix-bounds-{level}")
    return (
        sources.alias("s")
        .join(bounds.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left")
        .select("s.source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"))
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """All columns of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    Null or empty text: size 0, never any words to take. Null source: a source of its own, last.
    Null id: hashed as the empty text. Repeated rows share a hash and are taken alike. An empty
    table gives an empty table. Other columns pass through.
    """
    bounds = materialize(mix_thresholds(docs, weights, max_repeat), "mix-thresholds")
    bounds = broadcast_if_small(bounds.select(*[F.col(c).alias(f"mix__{c}") for c in bounds.columns]))
    joined = docs.join(bounds, docs["source"].eqNullSafe(bounds["mix__source"]))
    size = n_words(docs["text"])
    again = (mix_hash(docs["doc_id"], docs["text"]) < F.col("mix__threshold")).cast("long")
    return joined.select(
        *[docs[c] for c in docs.columns],
        size.alias("mix_size"),
        F.col("mix__source_size").alias("mix_source_size"),
        F.col("mix__target").alias("mix_target"),
        F.when(size > 0, F.col("mix__copies") + again).otherwise(F.lit(0)).cast("long").alias("mix_copies"),
    )

