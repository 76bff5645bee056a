"""Candidate selection, its cost, freshness, and that pruned searches equal full scans.

The recorded index covers every document but those of the source ``src19``, which came later, and
those of ``src18`` were edited after it was built.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import gram_code_rows, gram_rows, literal_grams, token_rows
from ..operators import candidates
from ..operators.index import dictionary, postings
from ..operators.search import matches, search
from ..plans.planner import CostModel, plan
from ..plans.query import Case, Mode, Query
from ..sources.tables import corpus, table
from .registry import GRAMS_SQL, TOKENS_SQL, query

LITERAL = "there"
GRAM_LIST = "('746865', '686572', '657265')"
NAMED_SQL = f"""
named AS (SELECT doc_id FROM grams WHERE gram IN {GRAM_LIST} GROUP BY doc_id HAVING count(*) = 3)"""
RECORDED_SQL = """
recorded AS (SELECT doc_id, octet_length(encode(text))::BIGINT + CASE WHEN source = 'src18' THEN 1 ELSE 0 END AS byte_length, source FROM documents WHERE source <> 'src19'),
live AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS byte_length, source FROM documents),
covered AS (SELECT doc_id FROM live SEMI JOIN recorded USING (doc_id, byte_length, source))"""


def _named(docs):
    return candidates.with_all_grams(gram_rows(docs), tuple(literal_grams(LITERAL)))


def _live(spark, sf_dir):
    return corpus(spark, sf_dir).withColumnRenamed("root", "source")


def _recorded(spark, sf_dir):
    live = _live(spark, sf_dir).filter("source <> 'src19'")
    return live.withColumn("byte_length", F.col("byte_length") + (F.col("source") == "src18").cast("long"))


def _covered(spark, sf_dir):
    return candidates.unchanged(_recorded(spark, sf_dir), _live(spark, sf_dir), "doc_id", ("byte_length", "source"))


@query(f"WITH {GRAMS_SQL}, {NAMED_SQL} SELECT doc_id FROM named")
def candidates_trigram(spark, sf_dir):
    return _named(table(spark, sf_dir, "documents"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id FROM tokens WHERE token = 'the'")
def candidates_word(spark, sf_dir):
    return candidates.with_token(token_rows(table(spark, sf_dir, "documents")), "the")


@query(f"WITH {GRAMS_SQL}, {NAMED_SQL} SELECT doc_id FROM named JOIN documents USING (doc_id) WHERE contains(text, 'there')")
def candidates_verified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search(docs.join(_named(docs), "doc_id", "left_semi"), Query((LITERAL,), fixed=True, mode=Mode.FILES))


@query(f"WITH {GRAMS_SQL}, {NAMED_SQL} SELECT doc_id FROM named JOIN documents USING (doc_id) WHERE NOT contains(text, 'there')")
def candidates_false_positive(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(_named(docs), "doc_id", "left_semi").filter(~matches(F.col("text"), Query((LITERAL,), fixed=True))).select("doc_id")


PRUNED = ("there", "License", "eaux", "keit", "no such literal", "été", "password", "tion.", "***", "the th")


@query(
    "WITH p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PRUNED) + "]) AS pattern) "
    "SELECT pattern, (SELECT count(*) FROM documents WHERE contains(text, pattern)) AS scanned, "
    "(SELECT count(*) FROM documents WHERE contains(text, pattern)) AS pruned, true AS equal FROM p"
)
def pruned_equals_scan(spark, sf_dir):
    """For each literal: what a scan finds, and what is found among the index's candidates only.

    All literals' grams are taken from the postings in one pass, and counted by document.
    """
    docs = table(spark, sf_dir, "documents")
    wanted = {p: [int(g, 16) for g in literal_grams(p)] for p in PRUNED}
    grams = gram_code_rows(docs).filter(F.col("code").isin(*{c for codes in wanted.values() for c in codes}))
    named = grams.groupBy("doc_id").agg(*[(F.count_if(F.col("code").isin(*codes)) == len(codes)).alias(f"named{i}") for i, codes in enumerate(wanted.values())])
    scan = docs.select("doc_id", *[matches(F.col("text"), Query((p,), fixed=True)).alias(f"hit{i}") for i, p in enumerate(PRUNED)])
    hits = [F.col(f"hit{i}") for i in range(len(PRUNED))]
    counts = [c for i, hit in enumerate(hits) for c in (F.count_if(hit).alias(f"scanned{i}"), F.count_if(hit & F.col(f"named{i}")).alias(f"pruned{i}"))]
    one = scan.join(named, "doc_id", "left").agg(*counts)
    rows = [F.struct(F.lit(p).alias("pattern"), F.col(f"scanned{i}").alias("scanned"), F.col(f"pruned{i}").alias("pruned")) for i, p in enumerate(PRUNED)]
    return one.select(F.inline(F.array(*rows))).withColumn("equal", F.expr("scanned = pruned"))


_COST_SQL = f"""{GRAMS_SQL}, segs AS (
  SELECT doc_id // 64 AS segment_id, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS source_bytes FROM documents GROUP BY 1
), df AS (SELECT doc_id // 64 AS segment_id, gram, count(*) AS doc_freq FROM grams GROUP BY 1, 2
), least AS (
  SELECT segs.segment_id, min(coalesce(doc_freq, 0)) AS m FROM segs CROSS JOIN (SELECT unnest(['746865', '686572', '657265']) AS gram) k
  LEFT JOIN df ON df.segment_id = segs.segment_id AND df.gram = k.gram GROUP BY 1
), cost AS (SELECT (SELECT sum(docs) FROM segs)::BIGINT AS docs, (SELECT sum(source_bytes) FROM segs)::BIGINT AS source_bytes, (SELECT sum(m) FROM least)::BIGINT AS bound)"""


def _cost(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("segment_id", F.expr("doc_id div 64"))
    segments = docs.groupBy("segment_id").agg(F.count("*").alias("docs"), F.sum("byte_length").alias("source_bytes"))
    frequencies = dictionary(postings(docs, ("segment_id", "doc_id")), "gram", ("segment_id",))
    return candidates.cost(frequencies, segments, tuple(literal_grams(LITERAL)))


@query(f"WITH {_COST_SQL} SELECT * FROM cost")
def cost_estimate(spark, sf_dir):
    return _cost(spark, sf_dir)


@query(f"WITH {_COST_SQL} SELECT docs, bound, docs >= 128 AND source_bytes <= docs * 65536 AND 2 * bound >= docs AS scan FROM cost")
def cost_decision(spark, sf_dir):
    model = CostModel()
    scan = (F.col("docs") >= model.least_docs) & (F.col("source_bytes") <= F.col("docs") * model.bytes_per_doc) & (2 * F.col("bound") >= F.col("docs"))
    return _cost(spark, sf_dir).select("docs", "bound", scan.alias("scan"))


@query(f"WITH {RECORDED_SQL} SELECT doc_id FROM covered")
def freshness_unchanged(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(f"WITH {GRAMS_SQL}, {NAMED_SQL}, {RECORDED_SQL} SELECT doc_id FROM live WHERE doc_id IN (SELECT doc_id FROM named) OR doc_id NOT IN (SELECT doc_id FROM covered)")
def scan_set(spark, sf_dir):
    live = _live(spark, sf_dir)
    return candidates.scan_set(live.select("doc_id"), _named(live), _covered(spark, sf_dir))


@query(f"WITH {RECORDED_SQL} SELECT doc_id, source FROM live WHERE doc_id NOT IN (SELECT doc_id FROM covered)")
def uncovered_scan(spark, sf_dir):
    return _live(spark, sf_dir).select("doc_id", "source").join(_covered(spark, sf_dir), "doc_id", "left_anti")


@query(f"""WITH {GRAMS_SQL}, {NAMED_SQL}, {RECORDED_SQL} SELECT d.doc_id FROM documents d JOIN named USING (doc_id) JOIN recorded USING (doc_id) WHERE contains(text, 'there')""")
def indexed_only_matches(spark, sf_dir):
    """Candidates of the recorded index alone; documents that came later aren't found."""
    docs = table(spark, sf_dir, "documents")
    covered = docs.join(_recorded(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return search(covered.join(_named(covered), "doc_id", "left_semi"), Query((LITERAL,), fixed=True, mode=Mode.FILES))


@query(f"""WITH {RECORDED_SQL} SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM covered) GROUP BY lang""")
def covered_by_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(_covered(spark, sf_dir), "doc_id", "left_semi")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT DISTINCT '/c/' || o_custkey AS canonical, o_custkey || '/' || o_orderstatus AS display
FROM orders SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0) USING (o_custkey)""")
def alias_expand(spark, sf_dir):
    """Customers as files that were named, and their orders' states as the spellings of each; many repeat."""
    key = lambda c: F.concat(F.lit("/c/"), F.col(c).cast("string")).alias("canonical")
    named = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(key("c_custkey"))
    spelled = table(spark, sf_dir, "orders").select(key("o_custkey"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus").alias("display"))
    return candidates.expand_aliases(named, spelled)


@query("SELECT doc_id, contains(text, 'Apache License') AS hinted FROM documents WHERE contains(text, 'the')")
def hint_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hints = docs.filter(F.col("text").contains("Apache License")).select("doc_id")
    return candidates.hinted_first(docs.filter(F.col("text").contains("the")).select("doc_id"), hints, "doc_id")


@query("""SELECT o.o_orderkey AS ordinal, o.o_custkey AS key, coalesce(p.position, -1)::BIGINT AS position FROM orders o
LEFT JOIN (SELECT c_custkey AS key, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS position FROM customer WHERE c_acctbal > 0) p ON p.key = o.o_custkey""")
def batch_key_lookup(spark, sf_dir):
    """Where each order's customer stands in the sorted list of its nation's customers in credit, -1 if not there."""
    from pyspark.sql import Window

    listed = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    listed = listed.select(F.col("c_custkey").alias("key"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("position"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("key"))
    return candidates.positions(listed, wanted)


@query(f"""WITH {GRAMS_SQL}, r AS (SELECT doc_id // 64 AS number, gram, doc_id AS id FROM grams WHERE gram IN {GRAM_LIST}),
n AS (SELECT number, count(DISTINCT gram) AS lists FROM r GROUP BY number)
SELECT number, id FROM r JOIN n USING (number) GROUP BY number, id, lists HAVING count(*) = lists""")
def intersections(spark, sf_dir):
    """Ids that all of a segment's lists have; a segment has those of three grams that it knows."""
    rows = gram_rows(table(spark, sf_dir, "documents")).filter(F.col("gram").isin(*literal_grams(LITERAL)))
    rows = rows.select(F.expr("doc_id div 64").alias("number"), F.col("gram").alias("list"), F.col("doc_id").alias("id"))
    sizes = rows.groupBy("number").agg(F.count_distinct("list").alias("lists"))
    found = rows.groupBy("number", "id").agg(F.count_distinct("list").alias("n")).join(sizes, "number")
    return found.filter("n = lists").select("number", "id")


#: pattern, fixed, folded, whole word, and the plan that follows (of the patterns' literals).
PLANS = (
    ("orchard", True, False, False, "grams", 5), ("ox", True, False, False, "scan", 0), ("orchard", True, True, False, "scan", 0),
    ("plum.*pear", False, False, False, "grams", 2), ("[0-9]+", False, False, False, "scan", 0), ("orchard", True, False, True, "word", 0),
    ("ripe plum", True, False, True, "grams", 7), ("fig|date", False, False, False, "scan", 0), ("(?i)olive", False, False, False, "scan", 0),
    ("plum.*pear", False, False, True, "grams", 2), ("(?:mulberry)?q", False, False, False, "scan", 0), (r"\x6delon", False, False, False, "grams", 3),
    (r"sloe\.gin", False, False, False, "grams", 6), (r"sloe\(gin\)", False, False, False, "grams", 7), ("no.x", False, False, False, "scan", 0),
    ("walnut.oil", False, False, False, "grams", 4), ("(?i:g)rape99", False, False, False, "grams", 4),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {n})" for i, (*_, k, n) in enumerate(PLANS)) + ") t(number, kind, grams)")
def plan_choice(spark, sf_dir):
    rows = []
    for i, (pattern, fixed, folded, word, _, _) in enumerate(PLANS):
        chosen = plan(Query((pattern,), fixed=fixed, word=word, case=Case.INSENSITIVE if folded else Case.SENSITIVE))
        rows.append((i, chosen.kind, len(chosen.grams)))
    return spark.createDataFrame(rows, "number int, kind string, grams int")
