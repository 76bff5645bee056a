"""What an index consists of: segments, ids, blocks, sizes, checks, and lookups in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grams import gram_name
from ..functions.text import gram_code_rows, gram_lists
from ..operators.index import (
    assign_ids,
    assign_segments,
    dictionary,
    gram_file_bytes,
    posting_blocks,
    postings,
    word_blocks,
    word_entries,
    word_file_bytes,
)
from ..operators.maintenance import increasing_lists
from ..sources.tables import corpus, number_roots, table
from .registry import GRAMS_SQL, TOKENS_SQL, query, values

CORPUS_SQL = """
c AS (
  SELECT doc_id, source AS root, lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS byte_length,
    (dense_rank() OVER (ORDER BY source) - 1)::BIGINT AS root_id FROM documents
)"""


@query(f"""WITH {CORPUS_SQL} SELECT doc_id, root_id,
  floor(coalesce(sum(byte_length) OVER (PARTITION BY root_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 65536)::BIGINT AS segment_no FROM c""")
def segments_assign(spark, sf_dir):
    """A new segment for every 64 KiB of a root, so that small tables have several."""
    docs = number_roots(corpus(spark, sf_dir))
    return assign_segments(docs, target=64 << 10).select("doc_id", "root_id", "segment_no")


@query(f"""WITH {CORPUS_SQL} SELECT doc_id, doc_id // 64 AS segment_id, (row_number() OVER (PARTITION BY doc_id // 64 ORDER BY root_id, path) - 1)::BIGINT AS local_id FROM c""")
def doc_ids_dense(spark, sf_dir):
    docs = number_roots(corpus(spark, sf_dir)).withColumn("segment_id", F.expr("doc_id div 64"))
    return assign_ids(docs).select("doc_id", "segment_id", "local_id")


@query(f"""WITH {GRAMS_SQL}, d AS (SELECT doc_id // 64 AS segment_id, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS source_bytes FROM documents GROUP BY 1),
g AS (SELECT doc_id // 64 AS segment_id, count(DISTINCT gram) AS n_grams, count(*) AS n_postings FROM grams GROUP BY 1),
j AS (SELECT d.segment_id, docs, source_bytes, coalesce(n_grams, 0) AS n_grams, coalesce(n_postings, 0) AS n_postings FROM d LEFT JOIN g USING (segment_id))
SELECT segment_id, sum(docs)::BIGINT AS docs, sum(source_bytes)::BIGINT AS source_bytes, sum(n_grams)::BIGINT AS n_grams, sum(n_postings)::BIGINT AS n_postings FROM j GROUP BY ROLLUP (segment_id)""")
def index_status(spark, sf_dir):
    """Segments, and their total with a null segment."""
    docs = corpus(spark, sf_dir).withColumn("segment_id", F.expr("doc_id div 64"))
    sizes = docs.groupBy("segment_id").agg(F.count("*").alias("docs"), F.sum("byte_length").alias("source_bytes"))
    grams = dictionary(gram_code_rows(docs, keep=("segment_id", "doc_id")), "code", ("segment_id",))
    grams = grams.groupBy("segment_id").agg(F.count("*").alias("n_grams"), F.sum("doc_freq").alias("n_postings"))
    joined = sizes.join(grams, "segment_id", "left").fillna(0, ["n_grams", "n_postings"])
    columns = ("docs", "source_bytes", "n_grams", "n_postings")
    return joined.rollup("segment_id").agg(*[F.sum(c).alias(c) for c in columns])


_BLOCKS = f"""{GRAMS_SQL}, numbered AS (
  SELECT gram, doc_id, (row_number() OVER (PARTITION BY gram ORDER BY doc_id) - 1) // 128 AS block_no FROM grams
), deltas AS (
  SELECT gram, doc_id, block_no, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY gram, block_no ORDER BY doc_id), 0) AS d FROM numbered
), blocks AS (
  SELECT gram, block_no::BIGINT AS block_no, count(*) AS n, max(doc_id) AS max_id,
    sum(CASE WHEN d < 128 THEN 1 WHEN d < 16384 THEN 2 WHEN d < 2097152 THEN 3 WHEN d < 268435456 THEN 4 ELSE 5 END)::BIGINT AS encoded_bytes
  FROM deltas GROUP BY gram, block_no
)"""


@query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def posting_block_layout(spark, sf_dir):
    blocks = posting_blocks(gram_code_rows(table(spark, sf_dir, "documents")), "code")
    return blocks.select(gram_name(F.col("code")).alias("gram"), *blocks.columns[1:])


@query(f"""WITH {_BLOCKS}, {CORPUS_SQL} SELECT docs, paths, n_grams, n_blocks, encoded, 90 + 64 * docs + 2 * paths + 16 * n_grams + 12 * n_blocks + encoded AS file_bytes
FROM (SELECT count(*) AS docs, sum(octet_length(encode(path)))::BIGINT AS paths FROM c),
  (SELECT count(DISTINCT gram) AS n_grams, count(*) AS n_blocks, sum(encoded_bytes)::BIGINT AS encoded FROM blocks)""")
def segment_size_model(spark, sf_dir):
    """How large one segment of all documents would be in the byte format."""
    docs = corpus(spark, sf_dir)
    blocks = posting_blocks(gram_code_rows(docs), "code")
    a = docs.agg(F.count("*").alias("docs"), F.sum(F.octet_length(F.encode("path", "UTF-8"))).alias("paths"))
    b = blocks.agg(F.count_if(F.col("block_no") == 0).alias("n_grams"), F.count("*").alias("n_blocks"), F.sum("encoded_bytes").alias("encoded"))
    both = a.unionByName(b, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.withColumn("file_bytes", gram_file_bytes(*map(F.col, ("docs", "paths", "n_grams", "n_blocks", "encoded"))))


@query(f"WITH {CORPUS_SQL} SELECT doc_id, 154 + 2 * octet_length(encode(path)) + 29 * greatest(byte_length - 2, 0) AS file_bytes FROM c")
def segment_size_formula(spark, sf_dir):
    """A segment for each document, if no gram came twice."""
    n = F.greatest(F.col("byte_length") - 2, F.lit(0))
    return corpus(spark, sf_dir).select("doc_id", gram_file_bytes(F.lit(1), F.octet_length(F.encode("path", "UTF-8")), n, n, n).cast("long").alias("file_bytes"))


@query(f"""WITH {TOKENS_SQL}, numbered AS (
  SELECT lower(left(token, 1)) AS shard, token, (row_number() OVER (PARTITION BY lower(left(token, 1)) ORDER BY token, doc_id) - 1) // 512 AS block_no FROM tokens
) SELECT shard, block_no::BIGINT AS block_no, min(token) AS first_token, max(token) AS last_token, count(*) AS n FROM numbered GROUP BY shard, block_no""")
def word_block_layout(spark, sf_dir):
    """Blocks of 512 entries, dealt by first letter."""
    return word_blocks(word_entries(table(spark, sf_dir, "documents")), F.lower(F.substring("token", 1, 1)))


@query(f"WITH {TOKENS_SQL} SELECT count(*) AS n_entries, (56 + 24 * ceil(count(*) / 512.0) + 12 * count(*))::BIGINT AS file_bytes FROM tokens")
def word_size_model(spark, sf_dir):
    counted = word_entries(table(spark, sf_dir, "documents")).agg(F.count("*").alias("n_entries"))
    return counted.withColumn("file_bytes", word_file_bytes(F.col("n_entries")).cast("long"))


@query(f"""WITH {GRAMS_SQL}, e AS (SELECT gram, doc_id, lang FROM grams JOIN documents USING (doc_id) UNION ALL SELECT gram, doc_id, lang FROM grams JOIN documents USING (doc_id) WHERE lang = 'fr')
SELECT lang, count(DISTINCT gram) AS lists, count(*) AS entries, lang <> 'fr' AS all_increasing FROM e GROUP BY lang""")
def validate_monotonic(spark, sf_dir):
    """Each language's lists; those of one language hold every id twice."""
    lists = gram_lists(table(spark, sf_dir, "documents"), keep=("doc_id", "lang"))
    return increasing_lists(lists.unionByName(lists.filter("lang = 'fr'")), by=("lang",))


@query(f"WITH {GRAMS_SQL} SELECT gram, count(*) AS doc_freq FROM grams WHERE gram IN ('746865', '656175', 'FFFFFF') GROUP BY gram")
def document_frequency(spark, sf_dir):
    return dictionary(postings(table(spark, sf_dir, "documents")).filter(F.col("gram").isin("746865", "656175", "FFFFFF")))


WANTED = "(0, 7), (1, 3), (2, 999999999), (3, 7)"


@query(f"SELECT w.ord, w.doc_id, source, n_chars FROM (VALUES {WANTED}) w(ord, doc_id) LEFT JOIN documents d ON d.doc_id = w.doc_id")
def document_bulk_get(spark, sf_dir):
    """Order and repeats of what is asked stay, and what isn't there is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return values(spark, WANTED, "ord, doc_id").join(docs, "doc_id", "left").select("ord", "doc_id", "source", "n_chars")


@query(f"WITH {CORPUS_SQL} SELECT doc_id, root_id FROM c WHERE root = 'src1' AND path = 'en/1.txt' OR root = 'src7' AND path = 'en/987.txt'")
def path_lookup(spark, sf_dir):
    docs = number_roots(corpus(spark, sf_dir))
    wanted = ((F.col("root") == "src1") & (F.col("path") == "en/1.txt")) | ((F.col("root") == "src7") & (F.col("path") == "en/987.txt"))
    return docs.filter(wanted).select("doc_id", "root_id")


@query("SELECT format('seg_{:08d}.tri', doc_id) AS name, doc_id FROM documents")
def segment_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.format_string("seg_%08d.tri", "doc_id").alias("name"), "doc_id")


@query("""SELECT p_partkey AS stem, p_partkey % 3 > 0 AS present, p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_partkey % 4 > 0 AS bound FROM part""")
def sidecar_binding(spark, sf_dir):
    """A word part counts only with the generation and fingerprint of its segment; none isn't an empty
    one. Every part of the table is a segment; some have no word part, and some another's."""
    segments = table(spark, sf_dir, "part")
    parts = segments.selectExpr("p_partkey AS stem", "p_size AS generation", "p_partkey % 7 AS fingerprint")
    sides = segments.filter("p_partkey % 3 > 0").selectExpr(
        "p_partkey AS stem", "p_size + int(p_partkey % 5 = 0) AS g", "p_partkey % 7 + int(p_partkey % 4 = 0) AS f", "true AS present"
    )
    joined = parts.join(sides, "stem", "left")
    same = (F.col("generation") == F.col("g")) & (F.col("fingerprint") == F.col("f"))
    return joined.select("stem", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce(same, F.lit(False)).alias("bound"))


@query(f"""WITH {GRAMS_SQL}, {TOKENS_SQL} SELECT docs, source_bytes, n_grams, n_postings, n_tokens FROM
  (SELECT count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS source_bytes FROM documents),
  (SELECT count(DISTINCT gram) AS n_grams, count(*) AS n_postings FROM grams), (SELECT count(DISTINCT token) AS n_tokens FROM tokens)""")
def engine_counters(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    parts = (
        docs.agg(F.count("*").alias("docs"), F.sum("byte_length").alias("source_bytes")),
        dictionary(gram_code_rows(docs), "code").agg(F.count("*").alias("n_grams"), F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("n_postings")),
        word_entries(docs).agg(F.count_distinct("token").alias("n_tokens")),
    )
    whole = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


@query("SELECT doc_id, source AS root, CASE WHEN source <> 'src19' THEN '/roots/' || source END AS root_path FROM documents")
def root_lookup(spark, sf_dir):
    """Each document's root in the list of known roots; null where the list has none."""
    docs = corpus(spark, sf_dir)
    roots = docs.filter("root <> 'src19'").select("root").distinct().withColumn("root_path", F.concat(F.lit("/roots/"), "root"))
    return docs.join(roots, "root", "left").select("doc_id", "root", "root_path")


SEGMENTS = "SELECT c_custkey AS stem, c_custkey % 4 AS version, c_nationkey % 3 AS root_id, CASE WHEN c_custkey % 5 > 0 THEN '/' || c_mktsegment ELSE c_mktsegment END AS root FROM customer"


@query(f"""SELECT stem, version >= 2 AS may_prune, root_id < 2 AS bound, left(root, 1) = '/' AS absolute,
  version >= 2 AND root_id < 2 AND left(root, 1) = '/' AS usable FROM ({SEGMENTS})""")
def usable_segments(spark, sf_dir):
    """Segments may prune from version 2, with roots that the list has, given from the top. Every
    customer is a segment."""
    root = F.when(F.expr("c_custkey % 5 > 0"), F.concat(F.lit("/"), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("root")
    rows = table(spark, sf_dir, "customer").select(F.expr("c_custkey AS stem"), F.expr("c_custkey % 4 AS version"), F.expr("c_nationkey % 3 AS root_id"), root)
    rows = rows.select("stem", (F.col("version") >= 2).alias("may_prune"), (F.col("root_id") < 2).alias("bound"), F.col("root").startswith("/").alias("absolute"))
    return rows.withColumn("usable", F.col("may_prune") & F.col("bound") & F.col("absolute"))


@query(f"WITH {GRAMS_SQL} SELECT doc_id FROM grams WHERE gram = '746865' ORDER BY doc_id LIMIT 20 OFFSET 20")
def candidate_page(spark, sf_dir):
    """The second page of twenty candidates."""
    return postings(table(spark, sf_dir, "documents")).filter("gram = '746865'").select("doc_id").orderBy("doc_id").offset(20).limit(20)


@query(f"WITH {TOKENS_SQL} SELECT count(*) AS total, least(count(*), 10) AS given FROM tokens WHERE token = 'the'")
def word_count_and_cap(spark, sf_dir):
    """A capped lookup still knows how many there are."""
    found = word_entries(table(spark, sf_dir, "documents")).filter("token = 'the'").agg(F.count("*").alias("total"))
    return found.withColumn("given", F.least("total", F.lit(10).cast("long")))


@query("""SELECT doc_id AS file_id, lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size FROM documents""")
def file_list(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "path", F.col("byte_length").alias("size"))
