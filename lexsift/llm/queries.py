"""The registered queries of this subpackage, one for each operator, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .covertree import nearest
from .jaccard import jaccard_components
from .langid import identify_languages
from .lm import score_documents
from .mixing import mix_documents
from .packing import pack_documents
from .quality import score_quality
from .rules import apply_rules
from .secrets import ALLOW, BASE, CANDIDATE, WINDOW, scan_secrets, spans_text
from .suffix import remove_repeats


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("secret_base"), F.col("secret_spans")
    count = lambda rank: F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id")) == 1
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.withColumn("held_out", held_out)


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id")) == 0
    score = F.col("quality_score")
    scored = score_quality(docs.select("doc_id", "text"), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id")) == 0
    found = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

def _matches_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, k, h, g, measured FROM (
    SELECT rid, regexp_extract_all(t, '{quoted}', 0) AS h, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}', {group}) AS measured FROM d
  ), unnest(range(1, len(h) + 1)) u(k) WHERE length(measured[k]) >= {least}"""


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), hits AS (
  {" UNION ALL ".join(_matches_sql(i, *row) for i, row in enumerate((*BASE, ("candidate", CANDIDATE, 0, 24))))}
), placed AS (
  SELECT rid, rank, kind, h[k] AS c, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a FROM hits
), base AS (SELECT rid, rank, kind, a, a + length(c) AS z FROM placed WHERE kind <> 'candidate'
), limits AS (
  SELECT rid, a, c, CASE WHEN regexp_matches(c, '^[0-9A-Fa-f]+$') AND regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Fa-f]') THEN 3.0
    WHEN regexp_matches(c, '[0-9]') AND regexp_matches(c, '[a-z]') AND regexp_matches(c, '[A-Z]') THEN 3.8
    WHEN regexp_matches(c, '[0-9]') AND regexp_matches(c, '[a-z]') THEN 3.6 WHEN regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Z]') THEN 3.6 END::DOUBLE AS bits
  FROM placed WHERE kind = 'candidate'{"".join(f" AND NOT regexp_matches(c, '{x.replace("++", "+")}')" for x in ALLOW)}
), windows AS (
  SELECT rid, a, i, bits, string_split(c[i + 1:i + {WINDOW}], '') AS w FROM limits, unnest(range(0, length(c) - {WINDOW} + 1)) u(i) WHERE bits IS NOT NULL
), counted AS (
  SELECT rid, a, i, bits, list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)) / {WINDOW}.0) AS p FROM windows
), flagged AS (
  SELECT rid, a, i, i - lag(i) OVER (PARTITION BY rid, a ORDER BY i) AS step FROM counted WHERE -list_sum(list_transform(p, lambda x: x * log2(x))) >= bits - 1e-9
), runs AS (
  SELECT rid, a + min(i) AS a, a + max(i) + {WINDOW} AS z FROM (
    SELECT rid, a, i, sum(CASE WHEN step <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, a ORDER BY i) AS run FROM flagged) GROUP BY rid, a, run
), spans AS (
  SELECT * FROM base UNION ALL SELECT rid, 3, 'entropy', a, z FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.a <= r.a AND r.z <= b.z)
), joined AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS s FROM spans GROUP BY rid
) SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN joined USING (rid)
"""

OP6_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), w AS (
  SELECT doc_id, p, sha256(t[p:p + 99]) AS h FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS p FROM b WHERE octet_length(t) >= 100)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), gaps AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM later
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM (
    SELECT doc_id, p, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gaps) GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, z + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, 1000000000000) AS z FROM runs
  UNION ALL SELECT doc_id, 1, min(a) - 1 FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(hex(t[a:z]), '' ORDER BY a) AS x FROM cuts JOIN b USING (doc_id) WHERE a <= z AND a <= octet_length(t) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(t) ELSE sha256(unhex(coalesce(x, ''))) END AS kept_sha256
FROM b LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || left(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 9))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size::DOUBLE * 3 AS cap, sum(source_size::DOUBLE) OVER () AS total FROM s
), w AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM r
), lev AS (
  SELECT arg_min((total - full_before) / weight_from, place) AS level FROM w WHERE cap > (total - full_before) / weight_from * weight
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM w, lev
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS copies,
    target - CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END * source_size AS budget
  FROM t
), g AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
), taken AS (
  SELECT g.source, g.h FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
  WHERE upto <= budget OR (upto - words <= budget AND (budget - (upto - words)) * 2 > words)
)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (d.size * (b.copies + (taken.h IS NOT NULL)::BIGINT))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN taken ON taken.source IS NOT DISTINCT FROM d.source AND taken.h = d.h
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w
  UNION SELECT r.doc_id, l.v FROM reach r JOIN linked l ON l.u = r.other
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.other) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_dual_cover_tree": op2_dual_cover_tree,
    "op3_secret_scan": op3_secret_scan,
    "op4_ppm_scoring": op4_ppm_scoring,
    "op5_quality_knn": op5_quality_knn,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_language_mixture": op8_language_mixture,
    "op9_line_rules": op9_line_rules,
    "op10_jaccard_components": op10_jaccard_components,
}

ORACLE_SQL: dict[str, str] = {
    "op2_dual_cover_tree": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_source_mixing": OP7_SQL,
    "op10_jaccard_components": OP10_SQL,
}
