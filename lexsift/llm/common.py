"""Helpers shared by the corpus operators: tables in the shared folder, and hash splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` as the session has it.

    A local session without that setting (tests) gets a temporary folder; a cluster without it
    is an error, because executors don't share local disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: Bytes of an Arrow batch, where the session doesn't say.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by bytes and not only by rows: texts differ in length
    by orders of magnitude. A size that the session has been given stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at the files,
    so a lost executor costs no recomputation. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that ``df`` has no column of; case doesn't count."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def number_rows(df: DataFrame, name: str, tag: str) -> DataFrame:
    """``df`` with a number for each row, written once: the number of a row depends on how a scan is
    split, and a later scan may be split otherwise (Spark looks at the cores it has by then)."""
    return materialize(df.select("*", F.monotonically_increasing_id().alias(name)), tag, "zstd")


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting the (materialised) rows; otherwise Spark's own join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bounded_sample(df: DataFrame, total: int, most: int, *keys: str) -> DataFrame:
    """About ``most`` of ``total`` rows, never more, chosen by a hash of ``keys``.

    A threshold on the hash lets few rows through before they are ordered, so what a task hands on
    doesn't grow with the number of tasks.
    """
    h = F.xxhash64(*keys)
    if total > most:
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int(most / total * (1 << 40)))
    return df.orderBy(h).limit(most)
