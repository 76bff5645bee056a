"""A persistent index: Parquet tables by segment, and a manifest that is published last.

    root/gen=N/documents, postings, words, dictionary, roots     tables of one snapshot, by segment_id
    root/gen=N/segments                                          what each finished segment holds
    root/manifest.json                                           the current generation

Entries are about contents: a row's key is its text's length and a 64-bit hash of it. A row of the
live table is answered for if a sound segment has its key, whatever its id, how often it is repeated,
and how many segments have it; a changed row has a new key. Everything else is scanned, and every
candidate is verified against the live text, so a stale, missing or damaged index never changes a
result. A segment is sound if its tables have as many rows as were counted when it was finished.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import candidates, maintenance
from .operators.index import dictionary, indexable, postings, word_entries
from .operators.search import search
from .plans.planner import CostModel, Plan, plan, validate
from .plans.query import Query

COUNTED = ("documents", "postings", "words", "dictionary")
PARTS = (*COUNTED, "roots", "segments")
KEY = ("byte_length", "fingerprint")
#: Files of a table for each segment, and bytes of text in a segment: some thousands for 100 TB.
FILES, TARGET_BYTES = 16, 16 << 30


class IndexCannotAnswer(RuntimeError):
    """The index can't answer, and was asked to answer alone."""


@dataclass
class Explanation:
    plan: Plan
    docs: int = 0
    source_bytes: int = 0
    bound: int = 0
    notes: list[str] = field(default_factory=list)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """The key of each row's text: its length in bytes and a hash. Null counts as the empty text."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.withColumn("byte_length", F.octet_length(text).cast("long")).withColumn("fingerprint", F.xxhash64(text))


class Index:
    """The index under ``root``, any folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, costs: CostModel | None = None):
        self.spark, self.root, self.costs = spark, root.rstrip("/"), costs or CostModel()

    # files, through Spark's file systems

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        fs, staged = self._fs(), self._path(f".{name}-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        # one step: a reader sees the old file or the new one
        hadoop, gateway = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        how = gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(self._path(name)), how)

    def manifest(self) -> dict | None:
        if not self._fs().exists(self._path("manifest.json")):
            return None
        stream = self._fs().open(self._path("manifest.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found = json.loads(text)
        if not isinstance(found.get("generation"), int) or any("/" in p for p in found.get("parts", [])):
            raise ValueError("the manifest isn't valid")
        return found

    def _part(self, name: str, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        if manifest is None:
            raise FileNotFoundError("there is no index")
        return self.spark.read.parquet(f"{self.root}/gen={manifest['generation']}/{name}")

    def _publish(self, generation: int) -> None:
        self._write("manifest.json", json.dumps({"generation": generation, "parts": list(PARTS)}))

    def _lock(self):
        """One writer: the lock file can be created once."""
        path = self._path("writer.lock")
        if not self._fs().createNewFile(path):
            raise RuntimeError("another writer is at work")
        return path

    # building and keeping

    def _finish(self, at: str, segment_id: int | None = None) -> None:
        """Count what the tables have by segment; segments that aren't in this table don't count."""
        one = f"/segment_id={segment_id}" if segment_id is not None else ""
        sizes = None
        for name in COUNTED:
            counted = self._by_segment(self.spark.read.parquet(f"{at}/{name}{one}"), segment_id).withColumnRenamed("n", name)
            sizes = counted if sizes is None else sizes.join(counted, "segment_id", "left")
        bytes_of = self.spark.read.parquet(f"{at}/documents{one}").withColumn("segment_id", F.lit(segment_id) if segment_id is not None else F.col("segment_id"))
        sizes = sizes.fillna(0).join(bytes_of.groupBy("segment_id").agg(F.sum("byte_length").alias("source_bytes")), "segment_id")
        sizes = sizes.select(*COUNTED, "source_bytes", "segment_id")  # a row for each segment
        target = sizes.drop("segment_id").coalesce(1).write.mode("overwrite") if one else sizes.coalesce(1).write.partitionBy("segment_id")
        target.parquet(f"{at}/segments{one}")

    @staticmethod
    def _by_segment(df: DataFrame, segment_id: int | None = None) -> DataFrame:
        df = df.withColumn("segment_id", F.lit(segment_id)) if segment_id is not None else df
        return df.groupBy(F.col("segment_id").cast("int").alias("segment_id")).agg(F.count("*").alias("n"))

    def _write_parts(self, at: str, kept: DataFrame, segment_id: int | None = None) -> None:
        """The tables of ``kept`` (segment_id, root, byte_length, fingerprint, text): all, or one segment's."""
        by = ("segment_id", *KEY)
        tables = {
            "documents": (kept.select(*by).distinct(), "fingerprint"),
            "postings": (postings(kept, by, once=False), "gram"),
            "words": (word_entries(kept, by, once=False), "token"),
        }
        for name, (df, key) in tables.items():
            self._save(self._dealt(df, key), f"{at}/{name}", segment_id)
        entries = self.spark.read.parquet(f"{at}/postings" + (f"/segment_id={segment_id}" if segment_id is not None else ""))
        entries = entries if segment_id is None else entries.withColumn("segment_id", F.lit(segment_id))
        self._save(dictionary(entries, "gram", ("segment_id",)), f"{at}/dictionary", segment_id)

    @staticmethod
    def _dealt(df: DataFrame, key: str) -> DataFrame:
        """FILES files for each segment, each in order of the key, so that few row groups hold a gram."""
        return df.repartition("segment_id", F.pmod(F.xxhash64(key), F.lit(FILES))).sortWithinPartitions("segment_id", key)

    @staticmethod
    def _save(df: DataFrame, path: str, segment_id: int | None) -> None:
        if segment_id is None:
            df.write.partitionBy("segment_id").parquet(path)
        else:
            df.drop("segment_id").write.mode("overwrite").parquet(f"{path}/segment_id={segment_id}")

    @staticmethod
    def _prepared(docs: DataFrame) -> DataFrame:
        """Rows to be indexed: those over the size gate or with a UTF-16 mark are left to scans."""
        root = F.coalesce(F.col("root"), F.lit("")) if "root" in docs.columns else F.lit("")
        keyed = with_fingerprint(docs.select(root.alias("root"), F.coalesce("text", F.lit("")).alias("text")))
        return keyed.filter(indexable(F.col("byte_length"), F.encode(F.substring("text", 1, 2), "UTF-8")))

    def build(self, docs: DataFrame, segments: int | None = None) -> int:
        """Index ``docs`` (text, and a root if they have one); returns the generation. Without
        ``segments`` there is one for every 16 GiB of text."""
        self._fs().mkdirs(self._path())
        lock = self._lock()
        try:
            before = self.manifest()
            generation = (before["generation"] if before else 0) + 1
            at = f"{self.root}/gen={generation}"
            self._fs().delete(self._path(f"gen={generation}"), True)
            kept = self._prepared(docs)
            if segments is None:
                segments = max(1, -(-(kept.agg(F.sum("byte_length")).first()[0] or 0) // TARGET_BYTES))
            kept = kept.withColumn("segment_id", F.pmod("fingerprint", F.lit(segments)).cast("int"))
            self._write_parts(at, kept)
            kept.select("root").distinct().write.parquet(f"{at}/roots")
            self._finish(at)
            self._publish(generation)
            return generation
        finally:
            self._fs().delete(lock, False)

    def rebuild(self, docs: DataFrame, segments: int | None = None) -> int:
        """A full build again, for the roots that the index is bound to."""
        if self.manifest() and "root" in docs.columns:
            roots, now = self._part("roots"), self._prepared(docs).select("root").distinct()
            if not (roots.join(now, "root", "left_anti").isEmpty() and now.join(roots, "root", "left_anti").isEmpty()):
                raise ValueError("the index is bound to other roots")
        return self.build(docs, segments)

    def append(self, docs: DataFrame, segment_id: int) -> None:
        """Add one segment of documents to the current snapshot (an extension: see streaming). It counts
        when its row in ``segments`` is written, at the end; a batch that runs again replaces it."""
        lock = self._lock()
        try:
            at = f"{self.root}/gen={self.manifest()['generation']}"
            self._fs().delete(self._path(at[len(self.root) + 1 :], "segments", f"segment_id={segment_id}"), True)
            kept = self._prepared(docs).withColumn("segment_id", F.lit(segment_id))
            self._write_parts(at, kept, segment_id)
            kept.select("root").distinct().join(self._part("roots"), "root", "left_anti").write.mode("append").parquet(f"{at}/roots")
            self._finish(at, segment_id)
        finally:
            self._fs().delete(lock, False)

    def compact(self) -> int:
        """Merge all sound segments into one, from the index alone; no document is read again."""
        manifest = self.manifest()
        if manifest is None:
            return 0
        if self._part("segments", manifest).count() <= 1:
            return manifest["generation"]
        lock = self._lock()
        try:
            manifest = self.manifest()
            generation = manifest["generation"] + 1
            at = f"{self.root}/gen={generation}"
            self._fs().delete(self._path(f"gen={generation}"), True)
            sound = F.broadcast(self.sound_segments(manifest).select("segment_id"))  # a row for each segment
            for name, key in (("documents", "fingerprint"), ("postings", "gram"), ("words", "token")):
                one = self._part(name, manifest).join(sound, "segment_id", "left_semi").withColumn("segment_id", F.lit(0)).distinct()
                self._save(self._dealt(one, key), f"{at}/{name}", None)
            self._save(dictionary(self.spark.read.parquet(f"{at}/postings"), "gram", ("segment_id",)), f"{at}/dictionary", None)
            self._part("roots", manifest).distinct().write.parquet(f"{at}/roots")
            self._finish(at)
            self._publish(generation)
            return generation
        finally:
            self._fs().delete(lock, False)

    def recover(self, stale_after: float | None = None) -> list[str]:
        """Delete snapshots that the manifest doesn't name; returns their names. A lock of a writer that
        died goes where it is older than ``stale_after`` seconds. Nothing is published."""
        lock = self._path("writer.lock")
        if stale_after is not None and self._fs().exists(lock) and time.time() - self._fs().getFileStatus(lock).getModificationTime() / 1000 > stale_after:
            self._fs().delete(lock, False)
        held = self._lock()
        try:
            manifest = self.manifest()
            current = f"gen={manifest['generation']}" if manifest else ""
            names = [s.getPath().getName() for s in self._fs().listStatus(self._path())]
            gone = sorted(n for n in names if n.startswith("gen=") and n != current)
            for name in gone:
                self._fs().delete(self._path(name), True)
            return gone
        finally:
            self._fs().delete(held, False)

    def sound_segments(self, manifest: dict | None = None) -> DataFrame:
        """(segment_id, documents, postings, words, dictionary, source_bytes) of segments whose tables
        have the rows that were counted when they were finished. Counts come from the files' footers."""
        manifest = manifest or self.manifest()
        segments = self._part("segments", manifest)
        for name in COUNTED:
            now = self._by_segment(self._part(name, manifest)).withColumnRenamed("n", "now")
            found = segments.join(now, "segment_id", "left").filter(F.coalesce("now", F.lit(0)) == F.col(name))
            segments = found.drop("now")
        return segments

    def status(self) -> DataFrame:
        """(segment_id, docs, source_bytes, grams, postings), a row for each segment; docs are different texts."""
        columns = ("segment_id", F.col("documents").alias("docs"), "source_bytes", F.col("dictionary").alias("grams"), "postings")
        return self._part("segments").select(*columns)

    def check(self) -> DataFrame:
        """One row: whether postings are distinct, name known documents, and agree with the dictionary,
        and how many segments have lost rows."""
        entries, docs, frequencies = self._part("postings"), self._part("documents"), self._part("dictionary")
        doubled = entries.groupBy("segment_id", "gram", *KEY).count().filter("count > 1")
        unknown = entries.join(docs, ["segment_id", *KEY], "left_anti")
        counted = dictionary(entries, "gram", ("segment_id",)).withColumnRenamed("doc_freq", "counted")
        differing = counted.join(frequencies, ["segment_id", "gram"], "full").filter("not (counted <=> doc_freq)")
        lost = self._part("segments").join(self.sound_segments().select("segment_id"), "segment_id", "left_anti")
        names = ("doubled", "unknown", "differing", "lost")
        found = [df.select(*[F.lit(int(n == name)).alias(n) for n in names]) for name, df in zip(names, (doubled, unknown, differing, lost), strict=True)]
        whole = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
        counts = whole.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        return counts.withColumn("valid", F.expr("doubled = 0 and unknown = 0 and differing = 0 and lost = 0"))

    def document_frequency(self, gram: str) -> DataFrame:
        return self._part("dictionary").filter(F.col("gram") == gram).agg(F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("doc_freq"))

    # searching

    def explain(self, query: Query) -> Explanation:
        """The plan, and what it would cost; nothing is searched."""
        validate(query)
        chosen = plan(query)
        out = Explanation(chosen)
        if chosen.kind != "grams":
            return out
        try:
            segments = self._part("segments").select("segment_id", F.col("documents").alias("docs"), "source_bytes")
            row = candidates.cost(self._part("dictionary"), segments, chosen.grams).first()
        except Exception as e:  # whatever is wrong with the index, the scan still answers
            out.notes.append(f"the index can't be read: {type(e).__name__}")
            return out
        out.docs, out.source_bytes, out.bound = row["docs"] or 0, row["source_bytes"] or 0, row["bound"]
        if self.costs.prefers_scan(out.docs, out.source_bytes, out.bound) and not query.indexed_only:
            out.plan = Plan("scan", reason="the index would leave most documents over")
        return out

    def candidates(self, chosen: Plan) -> DataFrame:
        """Keys of texts that one segment has under every gram, or under the token."""
        if chosen.kind == "word":
            return candidates.with_token(self._part("words"), chosen.token, ("segment_id", *KEY))
        return candidates.with_all_grams(self._part("postings"), chosen.grams, ("segment_id", *KEY))

    def scan_set(self, docs: DataFrame, query: Query) -> DataFrame:
        """The rows of ``docs`` that have to be read for the query, each as often as it stands there."""
        chosen = self.explain(query).plan
        if chosen.kind == "scan":
            if query.indexed_only:
                raise IndexCannotAnswer("the index can't answer this query alone")
            return docs
        live = with_fingerprint(docs.withColumn("live__row", F.struct(*docs.columns)))
        try:
            found = [r["segment_id"] for r in self.sound_segments().select("segment_id").collect()]  # eager: damage shows here
            if query.indexed_only and len(found) < self._part("segments").count():
                raise IndexCannotAnswer("a segment of the index is damaged")
            sound = F.col("segment_id").isin(found)
            named = self.candidates(chosen).filter(sound).select(*KEY).distinct()
            covered = self._part("documents").filter(sound).select(*KEY).distinct()
        except Exception:
            if query.indexed_only:
                raise
            return docs
        if query.indexed_only:
            return live.join(named, list(KEY), "left_semi").select("live__row.*")
        marked = candidates.to_scan(live, named, covered, KEY)
        return marked.select("live__row.*")

    def search(self, docs: DataFrame, query: Query, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        return search(self.scan_set(docs, query), query, keep)


def orphan_files(files: DataFrame, log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that neither a committed log record nor the manifest refers to."""
    kept = maintenance.committed(log).select(F.col("key").alias("stem")).unionByName(manifest.select("stem")).distinct()
    return maintenance.orphans(files, kept)
