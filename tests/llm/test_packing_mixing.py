import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexsift.llm.mixing import mix_documents
from lexsift.llm.packing import best_fit, pack_documents


def plain_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (b["left"], i) for i, b in enumerate(bins)
            if b["left"] >= size and (source < 0 or source not in b["s"]) and (cluster < 0 or cluster not in b["c"])
        ]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[at]["left"] -= size
        bins[at]["s"].add(source)
        bins[at]["c"].add(cluster)
        out.append(at)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(60):
        items = [(rng.randint(1, 20), rng.randint(-1, 6), rng.choice([-1, -1, 0, 1])) for _ in range(rng.randint(0, 80))]
        items.sort(key=lambda x: -x[0])
        assert best_fit(items, 20) == plain_best_fit(items, 20)


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for held in bins.values():
        assert sum(r["words"] for r in held) == held[0]["bin_words"] <= capacity
        sources = [r["source"] for r in held if r["source"] is not None]
        assert len(sources) == len(set(sources))
    return bins


def test_pack_odd_documents(odd_docs, no_docs):
    rows = pack_documents(odd_docs, capacity=500, rows_per_shard=16).collect()
    check_packing(rows, 500)
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += r["words"]
    want = Counter()
    for r in odd_docs.collect():
        want[r["doc_id"]] += len((r["text"] or "").split())
    assert words == want
    assert all(r["bin_id"] is None for r in rows if r["doc_id"] in (4, 5, 6)) and pack_documents(no_docs).count() == 0
    pieces = sorted((r["first_word"], r["words"]) for r in rows if r["doc_id"] == 7)
    assert pieces == [(i, 500) for i in range(0, 30_000, 500)]


def test_copies_are_kept_apart(spark):
    docs = spark.createDataFrame([(i, "one two three", None) for i in range(9)] + [(100 + i, f"x{i} y z", None) for i in range(9)], "doc_id long, text string, source string")
    rows = pack_documents(docs, capacity=9, rows_per_shard=100).collect()
    for held in check_packing(rows, 9).values():
        assert sum(r["doc_id"] < 100 for r in held) <= 1


def test_a_row_repeated_without_end_meets_all_shards(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'one two three' AS text", "'hot' AS source")
    packed = pack_documents(docs, capacity=9, rows_per_shard=100)
    rows = packed.collect()
    check_packing(rows, 9)
    per_shard = Counter(r["bin_id"] >> 32 for r in rows)
    assert len(rows) == 3000 and len(per_shard) == 30 and max(per_shard.values()) < 200
    assert sorted(rows) == sorted(pack_documents(docs.repartition(5), capacity=9, rows_per_shard=100).collect())


def targets_by_rounds(sizes, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mix(odd_docs, no_docs):
    mixed = mix_documents(odd_docs)
    assert set(odd_docs.columns) < set(mixed.columns) and mix_documents(no_docs).count() == 0
    rows = mixed.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix_documents(odd_docs).collect()))
    sizes = Counter()
    for r in rows:
        assert r["mix_size"] == len((r["text"] or "").split())
        sizes[r["source"]] += r["mix_size"]
    want = targets_by_rounds(sizes, 3)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]] and abs(r["mix_target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["mix_copies"] <= 3
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["mix_size"])
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * largest[s], 1)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(9)
    data = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), "hot" if i % 3 else rng.choice(["b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix_documents(docs).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_target").alias("target"))
    for r in got.collect():
        assert abs(r["taken"] - r["target"]) <= 20
