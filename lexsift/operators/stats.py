"""Statistics of timed trials, and the moving averages of the tuning table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a new sample in a moving average.
ALPHA = 0.1


def _ranks(trials: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(by, value, upto, n): each distinct value, how many are not above it, and how many there are.

    Rows are counted by value first, so that what is put in order is one row a value.
    """
    counts = trials.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.groupBy(*by).agg(F.sum("times").alias("n"))
    return counts.withColumn("upto", F.sum("times").over(order)).join(totals, list(by))


def _at(rank: Column, value: str) -> Column:
    """The value at a rank from 1, of the rows of ``_ranks``."""
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def trial_stats(trials: DataFrame, by: tuple[str, ...], value: str = "time_ms") -> DataFrame:
    """Least, median (whole numbers: the midpoint, rounded down), 95th percentile (the value at rank
    ceil(0.95 n)), greatest and mean of each group."""
    n = F.col("n")
    grouped = _ranks(trials, by, value).groupBy(*by).agg(
        F.max("n").alias("n"),
        F.min(value).alias("least"),
        _at(F.floor((n + 1) / 2), value).alias("low"),
        _at(F.floor(n / 2) + 1, value).alias("high"),
        _at(F.ceil(n * 0.95), value).alias("p95"),
        F.max(value).alias("greatest"),
    )
    means = trials.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"))
    median = (F.col("low") + F.shiftright(F.col("high") - F.col("low"), 1)).cast("long").alias("median")
    return grouped.join(means, list(by)).select(*by, "n", "least", median, "p95", "greatest", "mean")


def graph_p95(trials: DataFrame, by: tuple[str, ...], value: str = "time_ms") -> DataFrame:
    """The value at index int(0.95 n) from 0, as the graphs have it; not the same rank as above."""
    n = F.col("n")
    return _ranks(trials, by, value).groupBy(*by).agg(_at(F.least(F.floor(n * 0.95), n - 1) + 1, value).alias("p95"))


def speedups(trials: DataFrame, base: str, other: str, targets: dict[str, float]) -> DataFrame:
    """By category: the mean over patterns of median(other) / median(base), and whether the mean ratio
    base / other keeps to the category's target."""
    medians = trial_stats(trials, ("category", "pattern", "tool")).select("category", "pattern", "tool", "median")
    wide = medians.groupBy("category", "pattern").pivot("tool", [base, other]).agg(F.first("median"))
    target = F.element_at(F.create_map(*[x for c, t in targets.items() for x in (F.lit(c), F.lit(float(t)))]), F.col("category"))
    return wide.filter(f"`{base}` > 0 and `{other}` > 0").groupBy("category").agg(
        F.round(F.avg(F.col(other) / F.col(base)), 6).alias("speedup"),
        F.round(F.avg(F.col(base) / F.col(other)), 6).alias("ratio"),
        F.count("*").alias("patterns"),
    ).withColumn("passed", F.col("ratio") <= target)


def by_condition(trials: DataFrame, conditions: list[str], value: str = "time_ms") -> DataFrame:
    return trials.groupBy("category").pivot("condition", conditions).agg(F.round(F.avg(value), 6))


def moving_average(samples: DataFrame, by: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Exponential moving average in order; the first sample seeds it.

    Said as a sum: of n samples, the k-th weighs ALPHA (1 - ALPHA)^(n - k), and the first (1 - ALPHA)^(n - 1).
    """
    ranked = samples.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    ranked = ranked.join(samples.groupBy(*by).agg(F.count("*").alias("samples")), list(by))
    weight = F.pow(F.lit(1 - ALPHA), F.col("samples") - F.col("k")) * F.when(F.col("k") > 1, ALPHA).otherwise(1.0)
    return ranked.groupBy(*by).agg(F.max("samples").alias("samples"), F.sum(weight * F.col(value)).alias("average"))


def tune(samples: DataFrame, by: tuple[str, ...], least_samples: int = 5) -> DataFrame:
    """Fold samples (seq, config, speedup, confidence) of each signature in order.

    Speedup and confidence are averaged first; then the sample's config becomes the best one if its
    speedup times confidence is above the product of the new averages. ``config`` is null until there
    are ``least_samples``.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "config", "speedup", "confidence")))
    zero = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("int").alias("best"))

    def step(acc, x):
        s = F.coalesce(acc["s"] * (1 - ALPHA) + x["speedup"] * ALPHA, x["speedup"])
        c = F.coalesce(acc["c"] * (1 - ALPHA) + x["confidence"] * ALPHA, x["confidence"])
        better = acc["best"].isNull() | (x["speedup"] * x["confidence"] > s * c)
        return F.struct(s.alias("s"), c.alias("c"), F.when(better, x["config"].cast("int")).otherwise(acc["best"]).alias("best"))

    folded = samples.groupBy(*by).agg(rows.alias("rows")).withColumn("f", F.aggregate("rows", zero, step))
    return folded.select(
        *by,
        F.size("rows").cast("long").alias("samples"),
        F.col("f.s").alias("speedup"),
        F.col("f.c").alias("confidence"),
        F.when(F.size("rows") >= least_samples, F.col("f.best")).alias("config"),
    )


def result_parity(left: DataFrame, right: DataFrame, by: tuple[str, ...], item: str) -> DataFrame:
    """For each key: whether both sides have the same items, and whether the left is a part of the right."""
    a = left.select(*by, item).distinct().withColumn("l", F.lit(1))
    b = right.select(*by, item).distinct().withColumn("r", F.lit(1))
    both = a.join(b, [*by, item], "full")
    return both.groupBy(*by).agg(
        F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("equal"), F.bool_and(F.col("r").isNotNull()).alias("subset")
    )
