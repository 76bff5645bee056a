"""A training corpus from ``documents``, in five stages; each works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last give rows of
the columns of ``documents``: low-quality documents go, one document of each group of near copies
stays, secrets are blanked out, and sources are mixed to target weights (a document taken twice
stands there twice). The last packs the words that are left into bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsift.llm.common import fold, fresh_name, materialize, table
from lexsift.llm.jaccard import one_of_each
from lexsift.llm.mixing import mix_documents
from lexsift.llm.packing import pack_documents
from lexsift.llm.quality import score_quality
from lexsift.llm.secrets import redact, scan_secrets

#: Documents below this quality score go.
MIN_QUALITY = 0.3
#: The learned model can't be put into SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes mark as good. Null and empty texts are scored like others."""
    labels = table(spark, sf_dir, "labels")
    score = fresh_name(docs, "quality_score")
    scored = score_quality(docs, labels, fold(F.col("doc_id")) != 0, name=score)
    return scored.filter(F.col(score) >= MIN_QUALITY).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 per cent of their five-word shingles, the one of the smallest id."""
    return one_of_each(docs, k=5, num=80, den=100)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets become a mark, and n_chars follows the text.

    Null and empty texts and texts without a secret stay as they are; repeated rows are each blanked;
    very long texts are scanned whole; an empty table gives an empty table.
    """
    base, spans = fresh_name(docs, "secret_base"), fresh_name(docs, "secret_spans")
    scanned = scan_secrets(docs, names=(base, spans))
    clean = fresh_name(scanned, "clean")
    scanned = scanned.withColumn(clean, redact(F.col("text"), F.col(spans)))
    changed = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(spans) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return scanned.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are never taken."""
    taken = mix_documents(docs).filter("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words; copies of a document and documents of one source go to different bins."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", blank_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
