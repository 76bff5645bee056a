import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n_lines"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("lexsift/llm", "tests/llm"), ("lexsift/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_corpus_operators(tmp_path, gone):
    """In a copy where they are really deleted, the entry point has all the other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(os.path.dirname(os.path.abspath(entry.__file__)), copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "VERDICT.md"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True)
        (copy / name).unlink(missing_ok=True) if (copy / name).is_file() else None
    say = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'pipeline' in q, any(n[:2] == 'op' and n[2].isdigit() for n in q))"
    ran = subprocess.run([sys.executable, "-c", say], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    n, subset, pipeline, corpus = ran.stdout.split()
    assert int(n) > 100 and (subset, pipeline, corpus) == ("True", "False", "False")
