from pyspark.sql import functions as F

from lexsift.operators.search import search
from lexsift.plans.query import Case, Mode, Query
from lexsift.sources.config import case_of
from lexsift.sources.files import read_files, without
from lexsift.sources.rules import by_rules, ignored, included, parse_ignore


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"a needle\n")
    (tmp_path / "little.txt").write_bytes(b"\xff\xfe" + "needle\n".encode("utf-16-le"))
    (tmp_path / "big.txt").write_bytes(b"\xfe\xff" + "needle\n".encode("utf-16-be"))
    (tmp_path / "bin").write_bytes(b"needle\n\0tail")
    (tmp_path / "sub" / "b.txt").write_bytes(b"other \xff\n")
    (tmp_path / ".hidden").write_bytes(b"needle\n")
    files = read_files(spark, str(tmp_path))
    assert files.count() == 5
    found = search(files, Query(("needle",), word=True, mode=Mode.FILES), ("path",))
    assert sorted(r["path"].rpartition("/")[2] for r in found.collect()) == ["a.txt", "big.txt", "little.txt"]
    assert {r["path"].rpartition("/")[2] for r in files.filter("can_index").collect()} == {"a.txt", "b.txt", "bin"}
    assert without(files, f"file:{tmp_path}/sub").count() == 4


def test_ignore_rules(spark):
    paths = ["excluded.txt", "kept.txt", "sub/excluded.txt", "deep/sub/excluded.txt", "build/x", "a/build/y", "logs/a.log"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    rules = parse_ignore("# note\nexcluded.txt\nbuild/\n/logs/*.log\n")
    rules += parse_ignore("!excluded.txt\n", "sub", len(rules))
    kept = {r["path"] for r in rows.filter(~ignored(F.col("path"), rules)).collect()}
    assert kept == {"kept.txt", "sub/excluded.txt"}
    table = spark.createDataFrame([(r.number, r.regex, r.negated) for r in rules], "rule_no int, regex string, negated boolean")
    assert {r["path"] for r in by_rules(rows, table).filter("not ignored").collect()} == kept


def test_globs(spark):
    rows = spark.createDataFrame([("a.c",), ("b.h",), ("t/a.c",), ("t/x.py",)], "path string")
    kept = lambda globs: {r["path"] for r in rows.filter(included(F.col("path"), globs)).collect()}
    assert kept(["*.c"]) == {"a.c", "t/a.c"}
    assert kept(["!t/**"]) == {"a.c", "b.h"}
    assert kept(["*.{c,h}", "!t/*"]) == {"a.c", "b.h"}


def test_config():
    assert case_of("--ignore-case\n# x\n--smart-case\n") is Case.SMART


def test_trials_from_csv(spark, tmp_path):
    from lexsift.sources.trials import read_trials, write_report

    (tmp_path / "t.csv").write_text("pattern,category,trial,condition,ours_ms,scan_ms,files\nReturn,broad,01,cold,00310,02150,1\nReturn,broad,02,warm,080,1870,1\n")
    rows = read_trials(spark, str(tmp_path / "t.csv"))
    assert sorted((r["tool"], r["condition"], r["time_ms"]) for r in rows.collect()) == [("ours", "cold", 310), ("ours", "warm", 80), ("scan", "cold", 2150), ("scan", "warm", 1870)]
    write_report(rows, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 4
