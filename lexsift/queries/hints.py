"""The cache of results as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hints
from ..sources.tables import table
from .registry import query, values

#: One entry for every 64 documents; each fourth has an id that no document has.
CACHE_SQL = """cache AS (
  SELECT 'p' || g AS pattern, (g % 4)::INTEGER AS flags, (g % 3 + 1)::INTEGER AS generation, n + (g % 4 = 3)::BIGINT AS n, g::INTEGER AS cached_at, g
  FROM (SELECT doc_id // 64 AS g, count(*) AS n FROM documents GROUP BY 1))"""


def _cache(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id div 64 AS g", "doc_id").groupBy("g").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))  # 64 ids
    ids = F.when(F.expr("g % 4 = 3"), F.array_append("ids", F.lit(-1).cast("long"))).otherwise(F.col("ids"))
    return rows.select(
        F.concat(F.lit("p"), F.col("g").cast("string")).alias("pattern"),
        F.expr("int(g % 4)").alias("flags"),
        F.expr("int(g % 3 + 1)").alias("generation"),
        ids.alias("file_ids"),
        F.col("g").cast("int").alias("cached_at"),
    )


def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


@query(f"WITH {CACHE_SQL} SELECT count(*) AS entries, sum(n)::BIGINT AS file_refs, count(*) FILTER (generation <> 2) AS stale FROM cache")
def cache_status(spark, sf_dir):
    return hints.status(_cache(spark, sf_dir), 2)


@query(f"WITH {CACHE_SQL} SELECT pattern, flags, generation, n::INTEGER AS files, cached_at FROM cache ORDER BY cached_at LIMIT 50")
def cache_listing(spark, sf_dir):
    return hints.listing(_cache(spark, sf_dir))


@query(f"WITH {CACHE_SQL} SELECT pattern, flags, generation FROM cache WHERE generation = 2")
def cache_compact(spark, sf_dir):
    return hints.compact(_cache(spark, sf_dir), 2).select(*hints.KEY)


@query("SELECT lang || '/' || doc_id AS path FROM documents WHERE doc_id // 64 = 1")
def cache_lookup(spark, sf_dir):
    return hints.lookup(_cache(spark, sf_dir), _documents(spark, sf_dir), "p1", 1, 2)


@query("SELECT NULL::VARCHAR AS path WHERE false")
def cache_lookup_incomplete(spark, sf_dir):
    """One id that no document has makes the whole entry a miss."""
    return hints.lookup(_cache(spark, sf_dir), _documents(spark, sf_dir), "p3", 3, 1)


@query(f"WITH {CACHE_SQL} SELECT pattern, flags, generation, g % 4 <> 3 AS complete FROM cache")
def cache_completeness(spark, sf_dir):
    return hints.resolve(_cache(spark, sf_dir), _documents(spark, sf_dir)).select(*hints.KEY, "complete")


ROWS_SQL = """rows AS (
  SELECT CASE WHEN contains(text, 'License') THEN 'License' ELSE 'other' END AS pattern, 0 AS flags, 1 AS generation, lang || '/' || doc_id AS file_path, doc_id AS cached_at FROM documents
  UNION ALL SELECT 'gone', 1, 1, 'gone/1', 5 UNION ALL SELECT 'gone', 1, 1, 'en/1', 6)"""


def _rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.when(F.col("text").contains("License"), "License").otherwise("other").alias("pattern"),
        F.lit(0).alias("flags"),
        F.lit(1).alias("generation"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.col("doc_id").alias("cached_at"),
    )
    return rows.unionByName(values(spark, "('gone', 1, 1, 'gone/1', 5), ('gone', 1, 1, 'en/1', 6)", "pattern, flags, generation, file_path, cached_at"))


@query(f"WITH {ROWS_SQL} SELECT pattern, flags, generation, count(*) AS file_count FROM rows GROUP BY ALL")
def cache_enumerate(spark, sf_dir):
    return hints.enumerate_rows(_rows(spark, sf_dir))


@query(f"""WITH {ROWS_SQL} SELECT pattern, flags, generation, count(DISTINCT doc_id) AS files, min(doc_id) AS first_id, max(rows.cached_at)::BIGINT AS cached_at
FROM rows LEFT JOIN documents ON file_path = lang || '/' || doc_id GROUP BY ALL HAVING bool_and(doc_id IS NOT NULL)""")
def cache_migrate(spark, sf_dir):
    moved = hints.migrate(_rows(spark, sf_dir), _documents(spark, sf_dir)).groupBy(*hints.KEY)
    return moved.agg(F.count("*").alias("files"), F.min("file_id").alias("first_id"), F.max("cached_at").cast("long").alias("cached_at"))


@query(f"WITH {ROWS_SQL} SELECT file_path FROM rows WHERE NOT (pattern = 'License' AND flags = 0)")
def cache_invalidate(spark, sf_dir):
    return hints.invalidate(_rows(spark, sf_dir), "License", 0).select("file_path")


@query(f"WITH {CACHE_SQL} SELECT pattern, flags, generation, CASE WHEN g % 4 = 1 THEN 1 ELSE n END::INTEGER AS files FROM cache WHERE g % 4 <> 2 UNION ALL SELECT 'new', 4, 3, 2")
def cache_store(spark, sf_dir):
    """A new entry, new contents for each fourth, and incomplete ones that only take old ones out."""
    cache = _cache(spark, sf_dir)
    one = cache.filter("cached_at % 4 = 1").withColumn("file_ids", F.slice("file_ids", 1, 1))
    none = cache.filter("cached_at % 4 = 2").withColumn("file_ids", F.lit(None).cast("array<bigint>"))
    new = spark.createDataFrame([("new", 4, 3, [1, 2], 200)], "pattern string, flags int, generation int, file_ids array<bigint>, cached_at int")
    stored = hints.store(cache, one.unionByName(none).unionByName(new))
    return stored.select(*hints.KEY, F.size("file_ids").alias("files"))


@query(f"WITH {CACHE_SQL} SELECT pattern FROM cache ORDER BY cached_at DESC LIMIT 3")
def cache_evict(spark, sf_dir):
    return hints.evict_oldest(_cache(spark, sf_dir), 3).select("pattern")


@query("SELECT url AS pattern, flags FROM pages, (VALUES (0), (1), (2)) f(flags)")
def precache_variants(spark, sf_dir):
    return hints.warm_variants(table(spark, sf_dir, "pages").select(F.col("url").alias("pattern")), insensitive=True, word=True)
