"""Statistics of trials, over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources.tables import table
from ..sources.trials import markdown_rows
from .registry import query


def _trials(spark, sf_dir):
    """Events as trials: the type is the category, the value the milliseconds."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.floor(F.col("value") * 1000).cast("long").alias("time_ms"))


_TRIALS_SQL = "t AS (SELECT event_type AS category, floor(value * 1000)::BIGINT AS ms FROM events), s AS (SELECT category, list_sort(list(ms)) AS v, count(*) AS n, avg(ms) AS mean FROM t GROUP BY category)"


@query(f"""WITH {_TRIALS_SQL} SELECT category, n, v[1] AS least, (v[(n + 1) // 2] + (v[n // 2 + 1] - v[(n + 1) // 2]) // 2)::BIGINT AS median,
  v[ceil(n * 0.95)::BIGINT] AS p95, v[n] AS greatest, round(mean, 6) AS mean FROM s""")
def trial_stats(spark, sf_dir):
    return stats.trial_stats(_trials(spark, sf_dir), ("category",))


@query(f"WITH {_TRIALS_SQL} SELECT category, v[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95 FROM s")
def graph_p95(spark, sf_dir):
    return stats.graph_p95(_trials(spark, sf_dir), ("category",))


@query("""WITH t AS (SELECT event_type AS category, user_id % 20 AS pattern, list_sort(list(floor(value * 1000)::BIGINT + 1) FILTER (event_id % 2 = 0)) AS a, list_sort(list(floor(value * 1000)::BIGINT + 1) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY 1, 2),
m AS (SELECT category, a[(len(a) + 1) // 2] + (a[len(a) // 2 + 1] - a[(len(a) + 1) // 2]) // 2 AS ours, b[(len(b) + 1) // 2] + (b[len(b) // 2 + 1] - b[(len(b) + 1) // 2]) // 2 AS scan FROM t WHERE len(a) > 0 AND len(b) > 0),
r AS (SELECT category, round(avg(scan / ours), 6) AS speedup, round(avg(ours / scan), 6) AS ratio, count(*) AS patterns FROM m WHERE ours > 0 AND scan > 0 GROUP BY category)
SELECT *, ratio <= CASE category WHEN 'click' THEN 0.9 WHEN 'purchase' THEN 1.1 WHEN 'view' THEN 2.0 END AS passed FROM r""")
def category_speedup(spark, sf_dir):
    """Events as trials of two tools: even ones are ours."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_type AS category", "user_id % 20 AS pattern", "if(event_id % 2 = 0, 'ours', 'scan') AS tool", "bigint(floor(value * 1000)) + 1 AS time_ms"
    )
    return stats.speedups(rows, "ours", "scan", {"click": 0.9, "purchase": 1.1, "view": 2.0})


@query("""SELECT event_type AS category, round(avg(value) FILTER (event_id % 2 = 0), 6) AS cold, round(avg(value) FILTER (event_id % 2 = 1), 6) AS warm FROM events GROUP BY event_type""")
def condition_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("category"), F.when(F.col("event_id") % 2 == 0, "cold").otherwise("warm").alias("condition"), F.col("value").alias("time_ms")
    )
    return stats.by_condition(rows, ["cold", "warm"])


@query("""WITH a AS (SELECT lang, doc_id FROM documents WHERE contains(text, 'License')), b AS (SELECT lang, doc_id FROM documents WHERE contains(text, 'License') OR lang = 'de')
SELECT lang, count(a.doc_id) = count(b.doc_id) AS equal, true AS subset FROM b LEFT JOIN a USING (lang, doc_id) GROUP BY lang""")
def result_set_parity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = docs.filter(F.col("text").contains("License"))
    other = docs.filter(F.col("text").contains("License") | (F.col("lang") == "de"))
    return stats.result_parity(one, other, ("lang",), "doc_id")


@query("""WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, len(v)::BIGINT AS samples, round(list_reduce(v, lambda s, x: s * 0.9 + x * 0.1), 6) AS average FROM l""")
def ema_fold(spark, sf_dir):
    """A moving average of every user's values in order of time; the SQL folds them one by one."""
    averages = stats.moving_average(table(spark, sf_dir, "events"), ("user_id",), "event_id", "value")
    return averages.select("user_id", "samples", F.round("average", 6).alias("average"))


@query("""WITH l AS (SELECT user_id AS signature, list({'s': value, 'c': event_id % 10 / 10, 'best': (event_id % 7)::INTEGER} ORDER BY event_id) AS v FROM events GROUP BY user_id),
f AS (SELECT signature, len(v)::BIGINT AS samples, list_reduce(v, lambda a, x: {'s': a.s * 0.9::DOUBLE + x.s * 0.1::DOUBLE, 'c': a.c * 0.9::DOUBLE + x.c * 0.1::DOUBLE,
  'best': CASE WHEN x.s * x.c > (a.s * 0.9::DOUBLE + x.s * 0.1::DOUBLE) * (a.c * 0.9::DOUBLE + x.c * 0.1::DOUBLE) THEN x.best ELSE a.best END}) AS r FROM l)
SELECT signature, samples, CASE WHEN samples >= 5 THEN r.best END AS config FROM f""")
def tuning_fold(spark, sf_dir):
    """Every user's events as samples of seven settings; the SQL folds them one by one."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id AS signature", "event_id AS seq", "int(event_id % 7) AS config", "value AS speedup", "event_id % 10 / 10 AS confidence"
    )
    return stats.tune(rows, ("signature",)).select("signature", "samples", "config")


@query("""SELECT event_type, count(*) AS searches, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END)::BIGINT AS found, round(avg(value), 6) AS mean_value, round(max(value), 6) AS slowest
FROM events GROUP BY event_type""")
def query_log_counters(spark, sf_dir):
    """Counters of a query log, as the engine would keep them of itself."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("searches"), F.count_if(F.col("value") > 0).alias("found"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value"), 6).alias("slowest")
    )


@query("SELECT '| ' || lang || ' | ' || count(*) || ' | ' || sum(n_chars)::BIGINT || ' |' AS line FROM documents GROUP BY lang")
def markdown_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return markdown_rows(docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("n_chars")))
