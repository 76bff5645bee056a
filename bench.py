"""Headline queries, timed; prints one JSON line.

and on a persisted index that is built once, index analytics, and the corpus operators if they are
there. Each query's result is counted in full. Small queries: the better of two runs after one that
warms up.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from importlib.util import find_spec

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SCANS = (
    "search_absent_files", "search_fixed_files", "search_word_files", "search_icase_files", "search_selective_files",
    "search_fixed_count", "search_regex_lines", "search_multi_fixed", "search_pages_fixed", "trigram_dictionary",
    "word_dictionary", "candidates_trigram", "posting_block_layout", "index_status", "compact_postings", "trial_stats",
)
FAMILIES = {"absent": "no such literal", "fixed": "there", "selective": "Apache License, Version 2.0"}


def consume(df) -> int:
    """Run the whole query: every row and column is made, none is kept."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def timed(make, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.time()
        consume(make())
        best = min(best, time.time() - start)
    return round(best, 3)


def main() -> None:
    from lexsift.plans.query import Mode, Query
    from lexsift.queries import QUERIES
    from lexsift.session import local_session
    from lexsift.sources.tables import table
    from lexsift.store import Index

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=max(8, int(cpus)) if cpus.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    for name in SCANS:
        consume(QUERIES[name](spark, sf_dir))
        out[name] = timed(lambda n=name: QUERIES[n](spark, sf_dir), 2)

    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "root")
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    index = Index(spark, folder)
    start = time.time()
    index.build(docs)
    extra = {"index_build_sec": round(time.time() - start, 3)}
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    extra["index_bytes"] = size
    for family, literal in FAMILIES.items():
        only = Query((literal,), fixed=True, mode=Mode.FILES, indexed_only=True)
        consume(index.search(docs, only))
        out[f"indexed_{family}"] = timed(lambda q=only: index.search(docs, q), 2)

    if find_spec("lexsift.llm") is not None:
        from lexsift.llm.queries import QUERIES as CORPUS

        for name, query in CORPUS.items():
            out[name] = timed(lambda q=query: q(spark, sf_dir), 1)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
