"""Scalars and derived relations: grams, tokens, hashes, sizes, quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.grams import gram_name
from ..functions.text import csv_field, gram_code_rows, gram_rows, literal_grams, short_grams, token_rows, truncate_pattern
from ..operators.index import dictionary, indexable
from ..sources.tables import corpus, table
from .registry import GRAMS_SQL, TOKENS_SQL, query


@query(f"WITH {GRAMS_SQL} SELECT count(DISTINCT gram) AS unique_trigrams, count(*) AS total_postings, count(DISTINCT doc_id) AS docs FROM grams")
def trigram_stats(spark, sf_dir):
    """Grams are counted by gram first; documents that have any are those of three bytes."""
    docs = table(spark, sf_dir, "documents")
    lists = dictionary(gram_code_rows(docs), "code")
    parts = (
        lists.agg(F.count("*").alias("unique_trigrams"), F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("total_postings")),
        docs.filter(F.octet_length("text") >= 3).agg(F.count_distinct("doc_id").alias("docs")),
    )
    whole = parts[0].unionByName(parts[1], True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


@query(f"WITH {GRAMS_SQL} SELECT gram, count(*) AS doc_freq FROM grams GROUP BY gram")
def trigram_dictionary(spark, sf_dir):
    lists = dictionary(gram_code_rows(table(spark, sf_dir, "documents")), "code")
    return lists.select(gram_name(F.col("code")).alias("gram"), "doc_freq")


@query(f"WITH {GRAMS_SQL} SELECT gram, count(*) AS doc_freq, min(doc_id) AS first_doc, max(doc_id) AS last_doc, sum(doc_id)::BIGINT AS sum_ids FROM grams GROUP BY gram")
def posting_lists(spark, sf_dir):
    """Every list, by what identifies it."""
    lists = gram_code_rows(table(spark, sf_dir, "documents")).groupBy("code").agg(
        F.count("*").alias("doc_freq"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("doc_id").alias("sum_ids")
    )
    return lists.select(gram_name(F.col("code")).alias("gram"), *lists.columns[1:])


@query(f"WITH {TOKENS_SQL} SELECT token, count(*) AS doc_freq FROM tokens GROUP BY token")
def word_dictionary(spark, sf_dir):
    return token_rows(table(spark, sf_dir, "documents")).groupBy("token").agg(F.count("*").alias("doc_freq"))


@query(f"WITH {TOKENS_SQL} SELECT count(*) AS n_entries, count(DISTINCT token) AS n_tokens FROM tokens")
def word_stats(spark, sf_dir):
    return token_rows(table(spark, sf_dir, "documents")).agg(F.count("*").alias("n_entries"), F.count_distinct("token").alias("n_tokens"))


@query("""WITH i AS (SELECT p_partkey, hex(encode(p_name)[i:i + 2]) AS gram, i FROM (SELECT p_partkey, p_name, unnest(range(1, octet_length(encode(p_name)) - 1)) AS i FROM part))
SELECT p_partkey, gram, (row_number() OVER (PARTITION BY p_partkey ORDER BY min(i)) - 1)::INTEGER AS place FROM i GROUP BY p_partkey, gram""")
def literal_trigrams(spark, sf_dir):
    """The distinct grams of every part's name, in order of first occurrence."""
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(short_grams(F.col("p_name"))).alias("place", "gram"))


@query()
def token_hashes(spark, sf_dir):
    """Each distinct token's 64-bit hash; SQL has no multiplication modulo 2**64."""
    tokens = token_rows(table(spark, sf_dir, "documents")).select("token").distinct()
    return tokens.withColumn("token_hash", numeric.fnv1a64(F.encode("token", "UTF-8")))


@query()
def text_checksums(spark, sf_dir):
    """CRC32 of every text; DuckDB has no such function."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("checksum"))


@query()
def query_signatures(spark, sf_dir):
    grams = [int(g, 16) for g in literal_grams("there")]
    found = gram_rows(table(spark, sf_dir, "documents")).filter(F.col("gram").isin(literal_grams("there")))
    return found.agg(F.count("*").alias("postings")).select("postings", numeric.query_signature(F.array(*map(F.lit, grams)), F.col("postings")).alias("signature"))


@query("""SELECT v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS bytes
FROM (SELECT l_linenumber::BIGINT AS v FROM lineitem UNION ALL SELECT l_partkey FROM lineitem UNION ALL SELECT l_orderkey * l_partkey FROM lineitem UNION ALL SELECT l_orderkey * l_partkey * l_suppkey FROM lineitem)""")
def varint_lengths(spark, sf_dir):
    """Every line's number, part and two products: numbers of one byte to five."""
    products = F.array(F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.expr("l_orderkey * l_partkey"), F.expr("l_orderkey * l_partkey * l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.explode(products).alias("v"))
    return rows.withColumn("bytes", numeric.varint_length(F.col("v")))


@query("""SELECT event_id, i, w, f, (i::INTEGER + 2 * w::INTEGER + 4 * f::INTEGER)::INTEGER AS flags,
  coalesce(nullif(concat_ws(' ', CASE WHEN i THEN '-i' END, CASE WHEN w THEN '-w' END, CASE WHEN f THEN '-F' END), ''), 'default') AS flags_text
FROM (SELECT event_id, event_id % 2 = 1 AS i, event_id % 3 = 0 AS w, user_id % 5 = 0 AS f FROM events)""")
def flag_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id % 2 = 1 AS i"), F.expr("event_id % 3 = 0 AS w"), F.expr("user_id % 5 = 0 AS f"))
    rows = rows.withColumn("flags", numeric.cache_flags(F.col("i"), F.col("w"), F.col("f")))
    return rows.withColumn("flags_text", numeric.flags_text(F.col("flags")))


@query("""SELECT doc_id, n, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0)
  WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%d B', n) END AS size
FROM (SELECT doc_id, octet_length(encode(text))::BIGINT * (doc_id * doc_id + 1) AS n FROM documents)""")
def format_size(spark, sf_dir):
    n = F.octet_length(F.encode("text", "UTF-8")).cast("long") * (F.col("doc_id") * F.col("doc_id") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), numeric.format_size(n).alias("size"))


UNITS = ("", "B", "KB", "MB", "GB", "TB", "KiB", "MiB", "GiB", "TiB", "unknown", ".5MB")
QUANTITIES = f"""SELECT (CASE WHEN event_id % 17 = 0 THEN '' ELSE (event_id * 7919)::VARCHAR END) || [{", ".join(f"'{u}'" for u in UNITS)}][event_id % 12 + 1]
  || CASE WHEN event_id % 3 = 0 THEN '/s' ELSE '' END AS value, event_id % 4 = 0 AS rate FROM events"""


@query(f"""WITH q AS (SELECT value, rate, CASE WHEN rate THEN regexp_extract(value, '^(.*)/s$', 1) ELSE value END AS body FROM ({QUANTITIES})),
p AS (SELECT value, rate, regexp_extract(body, '^([0-9]+)([A-Za-z]*)$', 1) AS d, regexp_extract(body, '^([0-9]+)([A-Za-z]*)$', 2) AS u FROM q),
m AS (SELECT value, rate, try_cast(nullif(d, '') AS DECIMAL(24, 0)) * CASE u WHEN '' THEN 1 WHEN 'B' THEN 1 WHEN 'KB' THEN 1000 WHEN 'MB' THEN 1000000 WHEN 'GB' THEN 1000000000
  WHEN 'TB' THEN 1000000000000 WHEN 'KiB' THEN 1024 WHEN 'MiB' THEN 1048576 WHEN 'GiB' THEN 1073741824 WHEN 'TiB' THEN 1099511627776 END::DECIMAL(13, 0) AS n FROM p)
SELECT value, rate, CASE WHEN n > 0 AND n <= 18446744073709551615 THEN n END::VARCHAR AS bytes FROM m""")
def quantity_parse(spark, sf_dir):
    """Every event as a quantity: a number, one of twelve units or what isn't one, sometimes a rate."""
    number = F.when(F.expr("event_id % 17 = 0"), "").otherwise(F.expr("event_id * 7919").cast("string"))
    unit = F.element_at(F.array(*map(F.lit, UNITS)), F.expr("int(event_id % 12) + 1"))
    value = F.concat(number, unit, F.when(F.expr("event_id % 3 = 0"), "/s").otherwise(""))
    rows = table(spark, sf_dir, "events").select(value.alias("value"), F.expr("event_id % 4 = 0 AS rate"))
    return rows.withColumn("bytes", numeric.parse_quantity(F.col("value"), F.col("rate")).cast("string"))


@query("""SELECT page_id, CASE WHEN octet_length(encode(url)) <= 30 THEN url ELSE left(url, 27) || '...' END AS pattern FROM pages""")
def truncate_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", truncate_pattern(F.col("url")).alias("pattern"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM conversations""")
def csv_fields(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", csv_field(F.col("text")).alias("field"))


@query("""SELECT source AS root, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes, min(lang || '/' || doc_id || '.txt') AS first_path
FROM documents GROUP BY source""")
def corpus_roots(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("root").agg(
        F.count("*").alias("docs"), F.sum("byte_length").alias("bytes"), F.min("path").alias("first_path")
    )


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) * (doc_id % 7) * 20000 <= 67108864 AND doc_id % 11 > 1")
def size_and_bom_gate(spark, sf_dir):
    """Documents as if they were larger, some with a mark in front, that the build would index."""
    head = F.when(F.expr("doc_id % 11 = 0"), F.unhex(F.lit("FFFE6100"))).when(F.expr("doc_id % 11 = 1"), F.unhex(F.lit("FEFF0061")))
    length = F.octet_length(F.encode("text", "UTF-8")).cast("long") * F.expr("doc_id % 7") * 20_000
    return table(spark, sf_dir, "documents").filter(indexable(length, head.otherwise(F.encode("text", "UTF-8")))).select("doc_id")


@query("""SELECT event_id, (epoch_us(ts) * 1000)::BIGINT AS ns FROM events""")
def nanoseconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))


@query("""SELECT id, least(total // 8, available // 4, coalesce(headroom // 4, 9223372036854775807))::BIGINT AS memory, least(probe // 4, 536870912)::BIGINT AS io
FROM (SELECT o_orderkey AS id, o_orderkey * 4194304 AS total, o_custkey * 16777216 AS available, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 8388608 END AS headroom,
  floor(o_totalprice)::BIGINT * 20000 AS probe FROM orders)""")
def auto_budget(spark, sf_dir):
    """A build's budgets from what a machine has: an eighth of all, a quarter of what is free. Every order
    makes a machine."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey * 4194304 AS total", "o_custkey * 16777216 AS available",
        "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 8388608 END AS headroom", "bigint(floor(o_totalprice)) * 20000 AS probe",
    )
    quarter = F.coalesce(F.expr("headroom div 4"), F.lit((1 << 63) - 1))
    memory = F.least(F.expr("total div 8"), F.expr("available div 4"), quarter)
    return rows.select("id", memory.cast("long").alias("memory"), F.least(F.expr("probe div 4"), F.lit(512 << 20)).cast("long").alias("io"))


@query("""SELECT doc_id, 6 * n + 4 * p AS reserve FROM (
  SELECT doc_id, octet_length(encode(text))::BIGINT AS n, length(lang || '/' || doc_id || '.txt')::BIGINT AS p FROM documents)""")
def memory_reserve(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", (6 * F.col("byte_length") + 4 * F.length("path")).cast("long").alias("reserve"))


#: Every customer as a build that is under way, in a form of SQL that both engines read.
PROGRESS = "SELECT c_custkey AS id, c_custkey % 13 AS done, CAST(12 AS BIGINT) AS total, c_custkey AS elapsed FROM customer"


def _progress(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey % 13 AS done", "CAST(12 AS BIGINT) AS total", "c_custkey AS elapsed")


@query(f"SELECT id, done, total, elapsed, CASE WHEN done > 0 AND done < total THEN elapsed * (total - done) // done END::BIGINT AS eta FROM ({PROGRESS})")
def progress_eta(spark, sf_dir):
    rows = _progress(spark, sf_dir)
    eta = F.when((F.col("done") > 0) & (F.col("done") < F.col("total")), F.expr("elapsed * (total - done) div done"))
    return rows.withColumn("eta", eta.cast("long"))


@query("""SELECT event_id, bits, coalesce(nullif(concat_ws(' ', CASE WHEN bits & 1 <> 0 THEN 'sse42' END, CASE WHEN bits & 2 <> 0 THEN 'avx2' END,
  CASE WHEN bits & 4 <> 0 THEN 'avx512' END, CASE WHEN bits & 8 <> 0 THEN 'neon' END), ''), 'scalar') AS label FROM (SELECT event_id, event_id % 16 AS bits FROM events)""")
def feature_labels(spark, sf_dir):
    """Bits to names; Spark's own code generation makes the features themselves pointless here."""
    names = [F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(("sse42", "avx2", "avx512", "neon"))]
    label = F.concat_ws(" ", *names)
    return table(spark, sf_dir, "events").select("event_id", F.expr("event_id % 16 AS bits")).withColumn("label", F.when(label == "", "scalar").otherwise(label))


@query()
def xor_checksums(spark, sf_dir):
    """The older checksum of every page; SQL would have to take the words apart."""
    return table(spark, sf_dir, "pages").select("page_id", numeric.xor64(F.encode("html", "UTF-8")).alias("checksum"))


@query(f"""SELECT id, '{{"done":' || done || ',"total":' || total || ',"elapsed":' || elapsed || CASE WHEN done > 0 AND done < total THEN ',"eta":' || (elapsed * (total - done) // done) ELSE '' END || '}}' AS progress
FROM ({PROGRESS})""")
def progress_documents(spark, sf_dir):
    return _progress(spark, sf_dir).select("id", numeric.progress_json(F.col("done"), F.col("total"), F.col("elapsed")).alias("progress"))


@query("SELECT doc_id, '/data/' || source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents")
def full_paths(spark, sf_dir):
    """Roots joined with the paths below them."""
    return corpus(spark, sf_dir).select("doc_id", F.concat_ws("/", F.lit("/data"), "root", "path").alias("path"))
