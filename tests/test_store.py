import shutil

import pytest
from pyspark.sql import functions as F

from lexsift.operators.search import search
from lexsift.plans.query import Case, Mode, Query
from lexsift.sources.tables import table
from lexsift.store import Index, IndexCannotAnswer
from lexsift.streaming.refresh import refresh, stream_documents

NEEDLE = Query(("there",), fixed=True, mode=Mode.FILES)
ONLY = Query(("there",), fixed=True, mode=Mode.FILES, indexed_only=True)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.fixture()
def docs(spark, small):
    return table(spark, small, "documents").select("doc_id", "text", "source").withColumnRenamed("source", "root")


def test_life_of_an_index(spark, docs, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    assert index.manifest() is None and index.compact() == 0
    assert ids(index.search(docs, NEEDLE)) == ids(search(docs, NEEDLE))  # without an index: a scan
    assert index.build(docs, segments=4) == 1
    assert index.check().first()["valid"] and index.status().count() == 4
    frequency = index.document_frequency("746865").first()["doc_freq"]
    wanted = ids(search(docs, NEEDLE))
    assert ids(index.search(docs, ONLY)) == wanted
    assert index.compact() == 2
    assert index.status().count() == 1 and index.check().first()["valid"]
    assert index.document_frequency("746865").first()["doc_freq"] == frequency
    assert ids(index.search(docs, ONLY)) == wanted
    assert index.recover() == ["gen=1"] and index.recover() == []
    assert index.rebuild(docs, 2) == 3
    with pytest.raises(ValueError):
        index.rebuild(docs.filter("root <> 'src3'"))


@pytest.fixture(scope="module")
def sound(spark, small, tmp_path_factory):
    root = tmp_path_factory.mktemp("sound") / "i"
    docs = table(spark, small, "documents").select("doc_id", "text", F.col("source").alias("root"))
    Index(spark, str(root)).build(docs, segments=3)
    words = Query(("there",), fixed=True, word=True, mode=Mode.FILES)
    return root, words, ids(search(docs, NEEDLE)), ids(search(docs, words))


@pytest.mark.parametrize("part", ["documents", "postings", "words", "segments"])
@pytest.mark.parametrize("what", ["table", "segment", "file", "bytes"])
def test_damage_never_changes_a_result(spark, docs, sound, tmp_path, part, what):
    """A whole table, the folder of one segment, one file of it, or a file's contents are gone."""

    def harm(at):
        if what == "table":
            shutil.rmtree(at / part)
            return
        folder = at / part / "segment_id=1"
        if what == "segment":
            shutil.rmtree(folder)
            return
        file = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_size)
        file.unlink() if what == "file" else file.write_bytes(b"PAR1")
        for crc in folder.glob(".*.crc"):
            crc.unlink()

    root, words, needles, found = sound
    shutil.copytree(root, tmp_path / "i")
    harm(tmp_path / "i" / "gen=1")
    index = Index(spark, str(tmp_path / "i"))
    assert ids(index.search(docs, NEEDLE)) == needles
    assert ids(index.search(docs, words)) == found
    if part != "segments" or what in ("table", "bytes"):  # a segment that isn't listed was never finished
        with pytest.raises(Exception):
            ids(index.search(docs, ONLY))


def test_documents_that_come_again(spark, docs, tmp_path):
    """The same documents in two segments, a changed one, repeated ids and null ids: as a scan has them."""
    index = Index(spark, str(tmp_path / "i"))
    index.build(docs, segments=3)
    again = docs.filter("doc_id in (1, 2)").withColumn("text", F.concat(F.lit("there it is: "), "text"))
    index.append(docs.filter("doc_id between 1 and 40"), 7)
    index.append(again, 8)
    index.append(again, 8)
    some = spark.createDataFrame([(20, "over there", "src0"), (20, "nothing", "src0"), (None, "there", None), (None, "there", None), (21, None, "src1")], docs.select("doc_id", "text", "root").schema)
    changed = docs.filter("doc_id not in (1, 2)").select("doc_id", "text", "root").unionByName(again.select("doc_id", "text", "root"))
    many = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    for live in (docs, changed, changed.unionByName(some), docs.select("doc_id", "text", "root").unionByName(docs.select("doc_id", "text", "root"))):
        assert many(index.search(live, NEEDLE)) == many(search(live, NEEDLE))
    assert index.check().first()["valid"]
    assert index.compact() == 2 and index.check().first()["valid"]
    assert many(index.search(changed, ONLY)) == many(search(changed, NEEDLE))


def test_gates_and_many_roots(spark, docs, tmp_path):
    """What isn't indexed is scanned; an index is bound to all its roots."""
    marked = spark.createDataFrame([(i, "over there", f"r{i}") for i in range(300)], "doc_id long, text string, root string")
    index = Index(spark, str(tmp_path / "i"))
    index.build(marked)
    assert index.rebuild(marked) == 2
    for other in (marked.filter("doc_id < 299"), marked.withColumn("root", F.expr("if(doc_id = 299, 'new', root)"))):
        with pytest.raises(ValueError):
            index.rebuild(other)


def test_a_manifest_is_replaced_in_one_step(spark, docs, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(docs, segments=2)
    index.rebuild(docs, segments=2)
    assert index.manifest()["generation"] == 2 and not list((tmp_path / "i").glob(".manifest*-*"))
    (tmp_path / "i" / "writer.lock").touch()  # of a writer that died
    with pytest.raises(RuntimeError):
        index.recover(stale_after=3600)
    assert index.recover(stale_after=0) == ["gen=1"]


def test_alone_it_refuses_what_it_cant_answer(spark, docs, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(docs, segments=2)
    for query in (
        Query(("THERE",), case=Case.INSENSITIVE, indexed_only=True),
        Query(("n",), fixed=True, indexed_only=True),
        Query(("a", "b"), fixed=True, indexed_only=True),
    ):
        with pytest.raises(IndexCannotAnswer):
            index.search(docs, query)


def test_one_writer(spark, docs, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "writer.lock").touch()
    with pytest.raises(RuntimeError):
        index.build(docs)


def test_stream_adds_segments(spark, docs, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(docs.filter("doc_id < 100"), segments=2)
    arriving = str(tmp_path / "in")
    docs.filter("doc_id >= 100").coalesce(1).write.parquet(arriving)
    for _ in range(2):  # the second run finds nothing new
        stream = stream_documents(spark, arriving, "doc_id long, text string, root string")
        refresh(index, stream, str(tmp_path / "cp")).awaitTermination()
    assert index.status().count() == 3 and index.check().first()["valid"]
    assert ids(index.search(docs, ONLY)) == ids(search(docs, NEEDLE))
