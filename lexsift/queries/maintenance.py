"""Log replay, compaction, orphans, disk usage and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grams import gram_name
from ..functions.text import gram_lists
from ..operators import maintenance
from ..sources.tables import corpus, number_roots, table
from ..store import orphan_files
from .index import CORPUS_SQL
from .registry import GRAMS_SQL, query, values

LOG = """(1, 1, 'BEGIN', ''), (2, 1, 'INSERT', 'committed'), (3, 1, 'COMMIT', ''), (4, 1, 'BEGIN', ''), (5, 1, 'INSERT', 'not-committed'),
(6, 10, 'BEGIN', ''), (7, 20, 'BEGIN', ''), (8, 10, 'INSERT', 'interleaved'), (9, 20, 'INSERT', 'aborted'), (10, 10, 'COMMIT', ''), (11, 20, 'ABORT', ''),
(12, 30, 'BEGIN', ''), (13, 30, 'INSERT', 'unfinished'), (14, 40, 'BEGIN', ''), (15, 40, 'INSERT', 'first'), (16, 40, 'COMMIT', ''),
(17, 40, 'BEGIN', ''), (18, 40, 'INSERT', 'second'), (19, 40, 'COMMIT', ''), (20, 50, 'INSERT', 'stray'), (21, 50, 'COMMIT', '')"""

REPLAY_SQL = f"""
log AS (SELECT *, sum(CASE WHEN op = 'BEGIN' THEN 1 ELSE 0 END) OVER (PARTITION BY txn ORDER BY ord) AS inc FROM (VALUES {LOG}) t(ord, txn, op, key)),
r AS (SELECT txn, inc, min(ord) FILTER (op = 'BEGIN') AS b, min(ord) FILTER (op IN ('COMMIT', 'ABORT')) AS e, min(ord) FILTER (op = 'COMMIT') AS c FROM log WHERE inc > 0 GROUP BY txn, inc),
replayed AS (SELECT ord, log.txn, key FROM log JOIN r ON r.txn = log.txn AND r.inc = log.inc WHERE op = 'INSERT' AND e = c AND ord > b AND ord < e)"""


@query(f"WITH {REPLAY_SQL} SELECT * FROM replayed")
def wal_replay(spark, sf_dir):
    return maintenance.committed(values(spark, LOG, "ord, txn, op, key"))


EVENTS_SQL = """
SELECT ord, txn, key FROM (
  SELECT event_id AS ord, user_id AS txn, event_id::VARCHAR AS key, event_type,
    sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS inc FROM events) l
JOIN (SELECT user_id, inc, min(event_id) FILTER (event_type = 'click') AS b, min(event_id) FILTER (event_type IN ('purchase', 'error')) AS e,
    min(event_id) FILTER (event_type = 'purchase') AS c FROM (
    SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS inc FROM events)
  WHERE inc > 0 GROUP BY user_id, inc) r ON r.user_id = l.txn AND r.inc = l.inc
WHERE event_type NOT IN ('click', 'purchase', 'error') AND e = c AND ord > b AND ord < e"""


def _event_log(spark, sf_dir):
    op = F.when(F.col("event_type") == "click", "BEGIN").when(F.col("event_type") == "purchase", "COMMIT").when(F.col("event_type") == "error", "ABORT").otherwise("INSERT")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("txn"), op.alias("op"), F.col("event_id").cast("string").alias("key")
    )


@query(EVENTS_SQL)
def wal_replay_events(spark, sf_dir):
    """The same interval join over the table of events: what lies between a click and its purchase."""
    return maintenance.committed(_event_log(spark, sf_dir))


@query(f"""SELECT event_id || CASE event_id % 4 WHEN 0 THEN '.tri' WHEN 1 THEN '.wrd' WHEN 2 THEN '.old' ELSE '.json' END AS name FROM events
WHERE event_id % 4 < 3 AND event_id % 10 > 0 AND event_id::VARCHAR NOT IN (SELECT key FROM ({EVENTS_SQL}))""")
def wal_orphans(spark, sf_dir):
    """A file for each event: neither the log's committed inserts nor the list of what is kept refer to it."""
    events = table(spark, sf_dir, "events")
    stem = F.col("event_id").cast("string")
    ending = F.element_at(F.array(*map(F.lit, (".tri", ".wrd", ".old", ".json"))), F.expr("int(event_id % 4) + 1"))
    kept = events.filter("event_id % 10 = 0").select(stem.alias("stem"))
    return orphan_files(events.select(F.concat(stem, ending).alias("name")), _event_log(spark, sf_dir), kept)


@query("""SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.tri' ELSE '.wrd' END AS name FROM documents WHERE doc_id % 3 < 2 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def unreferenced_files(spark, sf_dir):
    """A file for each document, of which those with a label are referred to."""
    stem = F.col("doc_id").cast("string")
    ending = F.element_at(F.array(*map(F.lit, (".tri", ".wrd", ".json"))), F.expr("int(doc_id % 3) + 1"))
    files = table(spark, sf_dir, "documents").select(F.concat(stem, ending).alias("name"))
    return maintenance.orphans(files, table(spark, sf_dir, "labels").select(stem.alias("stem")).distinct())


REMAP_SQL = f"""{CORPUS_SQL}, ids AS (
  SELECT doc_id, doc_id // 64 AS segment_id, (row_number() OVER (PARTITION BY doc_id // 64 ORDER BY root_id, path) - 1)::BIGINT AS local_id FROM c
), mapping AS (SELECT doc_id, segment_id, local_id, (row_number() OVER (ORDER BY segment_id, local_id) - 1)::BIGINT AS new_id FROM ids)"""


def _segmented(spark, sf_dir):
    from ..operators.index import assign_ids

    return assign_ids(number_roots(corpus(spark, sf_dir)).withColumn("segment_id", F.expr("doc_id div 64")))


@query(f"WITH {REMAP_SQL} SELECT segment_id, local_id, new_id FROM mapping")
def compact_remap(spark, sf_dir):
    return maintenance.remap(_segmented(spark, sf_dir))


@query(f"WITH {REMAP_SQL}, {GRAMS_SQL} SELECT gram, count(*) AS doc_freq, min(new_id) AS first_id, max(new_id) AS last_id, sum(new_id)::BIGINT AS sum_ids FROM grams JOIN mapping USING (doc_id) GROUP BY gram")
def compact_postings(spark, sf_dir):
    """Every list of the merged segment, by what identifies it."""
    docs = _segmented(spark, sf_dir)
    lists = gram_lists(docs, keep=("segment_id", "local_id"), once=True)
    one = maintenance.merged(lists, maintenance.remap(docs), "codes").select("local_id", F.explode("codes").alias("code"))
    one = one.groupBy("code").agg(
        F.count("*").alias("doc_freq"), F.min("local_id").alias("first_id"), F.max("local_id").alias("last_id"), F.sum("local_id").alias("sum_ids")
    )
    return one.select(gram_name(F.col("code")).alias("gram"), *one.columns[1:])


@query("SELECT o_orderpriority AS gram, (row_number() OVER (ORDER BY o_custkey % 10, o_orderkey) - 1)::BIGINT AS local_id FROM orders")
def compact_small(spark, sf_dir):
    """Orders as documents of ten segments, their priority as the only gram of each."""
    docs = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 AS segment_id", "o_orderkey AS local_id", "o_orderpriority AS gram")
    return maintenance.merged(docs, maintenance.remap(docs.drop("gram")), "gram")


@query("""WITH f AS (SELECT doc_id, n_chars AS bytes, (n_chars // 4096 + 1) * 4096 AS allocated, ['tri', 'wrd', 'old', 'tmp', ''][doc_id % 5 + 1] AS part, doc_id % 3 > 0 AS active FROM documents),
s AS (SELECT coalesce(sum(bytes) FILTER (active AND part = 'tri'), 0)::BIGINT AS trigram, coalesce(sum(bytes) FILTER (active AND part = 'wrd'), 0)::BIGINT AS word, coalesce(sum(bytes) FILTER (active AND part = 'old'), 0)::BIGINT AS legacy,
  coalesce(sum(bytes) FILTER (NOT active AND part IN ('tri', 'wrd', 'old')), 0)::BIGINT AS other, coalesce(sum(bytes) FILTER (part IN ('tmp', '')), 0)::BIGINT AS auxiliary, sum(bytes)::BIGINT AS logical FROM f)
SELECT s.*, a.allocated FROM s, (SELECT sum(m)::BIGINT AS allocated FROM (SELECT max(allocated) AS m FROM f GROUP BY doc_id // 2)) a""")
def disk_usage_hardlinks(spark, sf_dir):
    """A file for each document, two links for each place on the disk."""
    ending = F.element_at(F.array(*map(F.lit, (".tri", ".wrd", ".old", ".tmp", ""))), F.expr("int(doc_id % 5) + 1"))
    docs = table(spark, sf_dir, "documents")
    files = docs.select(
        F.concat(F.col("doc_id").cast("string"), ending).alias("name"), F.col("n_chars").alias("bytes"), F.expr("(n_chars div 4096 + 1) * 4096 AS allocated"), F.lit(1).alias("dev"), F.expr("doc_id div 2 AS inode")
    )
    return maintenance.disk_usage(files, docs.filter("doc_id % 3 > 0").select(F.col("doc_id").cast("string").alias("stem")))


@query("""SELECT lang || '/' || doc_id AS path, CASE WHEN source = 'src19' THEN 'added' WHEN source = 'src18' THEN 'changed' ELSE 'same' END AS state
FROM documents UNION ALL SELECT 'gone/' || page_id, 'removed' FROM pages""")
def inventory_diff(spark, sf_dir):
    """Documents against an older list: some edited, some new, and pages that are gone."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    now = docs.select(path.alias("path"), digest.alias("digest"))
    old = docs.filter("source <> 'src19'").select(path.alias("path"), F.when(F.col("source") == "src18", F.lit("older")).otherwise(digest).alias("digest"))
    gone = table(spark, sf_dir, "pages").select(F.concat(F.lit("gone/"), F.col("page_id").cast("string")).alias("path"), F.lit("x").alias("digest"))
    return maintenance.inventory_diff(old.unionByName(gone), now)


@query("""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS kind, sum(octet_length(encode(html)))::BIGINT AS bytes, count(*) AS files FROM pages GROUP BY 1""")
def footprint_by_kind(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("kind")).agg(
        F.sum(F.octet_length(F.encode("html", "UTF-8"))).alias("bytes"), F.count("*").alias("files")
    )
