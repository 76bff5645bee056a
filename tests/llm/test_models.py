"""Operators 4, 5, 8 and 9: brute force for what is counted, held-out accuracy for what is learned."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsift.llm import lm, quality, rules
from lexsift.llm.common import fold, materialize, table
from lexsift.llm.langid import identify_languages
from lexsift.llm.quality import score_quality

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bucket(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def test_unigram_base(odd_docs):
    rows = odd_docs.collect()
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for r in rows:
        if bucket(r["doc_id"]) != 1:
            counts.update(tokens(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        own = tokens(r["text"])
        score = sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        want.append((r["doc_id"], len(own), sum(counts[t] > 0 for t in own), total, round(float(score), 6)))
    for head in (200_000, 5):  # with nearly all words left to the join, the sums are the same
        got = lm.score_documents(odd_docs, fold(F.col("doc_id")) != 1, max_head=head).collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got)


def plain_ppm(levels, context: bytes, byte: int) -> float:
    out, ruled_out = 1.0, set()
    for order in range(lm.ORDER, -1, -1):
        seen = {s: c for s, c in levels[order].get(context[len(context) - order :], {}).items() if s not in ruled_out}
        if not seen:
            continue
        total = sum(seen.values())
        if byte in seen:
            return out * (2 * seen[byte] - 1) / (2 * total)
        out *= len(seen) / (2 * total)
        ruled_out |= set(seen)
    return out / (256 - len(ruled_out))


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog sat on the log"), (3, "été")], "doc_id long, text string")
    return lm.train(docs)


def test_ppm_equals_the_plain_walk(trained):
    levels = trained[4]
    plain = [{} for _ in range(lm.ORDER + 1)]
    for order, (keys, counts) in enumerate(levels):
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            raw = k.to_bytes(order + 1, "big")
            plain[order].setdefault(raw[:-1], {})[raw[-1]] = n
    trie = lm.Trie(levels)
    for context in (b"\xff\xff\xff\xff\xff", b"n the", b" cat ", b"zzzzz", b"e mat", "été".encode()):
        keys = np.array([int.from_bytes(context[-5:] + bytes([b]), "big") for b in range(256)], np.uint64)
        want = np.array([plain_ppm(plain, context[-5:], b) for b in range(256)])
        assert np.allclose(10 ** trie.log10(keys), want, rtol=1e-5)
        assert np.allclose(10 ** trie.walk(keys), want, rtol=1e-9)
        assert want.sum() <= 1 + 1e-9 and want.min() > 0


def test_ppm_scores_whole_texts(spark, trained):
    texts = ["the cat sat", "", None, "THE CAT SAT", "qqqq", "x" * 70_000]
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog sat on the log"), (3, "été")] + [(10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") < 10).collect()}
    assert got[10] == got[13] and got[11] == got[12] and got[14] < got[10] < 0
    trie = lm.Trie(trained[4])
    raw = b"\xff" * 5 + b"the cat sat" + b"\xff"
    keys = np.array([int.from_bytes(raw[i : i + 6], "big") for i in range(len(raw) - 5)], np.uint64)
    assert abs(got[10] - trie.log10(keys).sum()) < 1e-4


@pytest.mark.parametrize("most", [3, 200, 1200])
def test_ppm_leaves_no_string_out(odd_docs, most):
    """However few strings are sent out, every string counts."""
    docs, learned = odd_docs.filter("doc_id <> 7 or doc_id is null"), fold(F.col("doc_id")) != 1
    whole = lm.score_documents(docs, learned).collect()
    got = lm.score_documents(docs, learned, max_nodes=most).collect()
    plain = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["score"]) for r in rows)
    for a, b in zip(plain(whole), plain(got), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    got = lm.score_documents(odd_docs, F.lit(False)).collect()
    assert len(got) == odd_docs.count() and all(r["n_known"] == 0 == r["train_tokens"] for r in got)
    assert lm.score_documents(no_docs, F.lit(True)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["quality_score"] for r in score_quality(odd_docs, labels, F.lit(True)).collect()} == {0.5}
    assert score_quality(no_docs, labels, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(odd_docs, F.lit(False)).collect()} == {"und"}
    assert identify_languages(no_docs, F.lit(True)).count() == 0


def test_quality_held_out(spark, some):
    docs, labels = table(spark, some, "documents"), table(spark, some, "labels")
    scored = score_quality(docs, labels, fold(F.col("doc_id")) != 0)
    rows = scored.join(labels, "doc_id").filter(fold(F.col("doc_id")) == 0).collect()
    good = np.array([r["quality_score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["quality_score"] for r in rows if r["quality"] == 0])
    assert (good[:, None] > bad).mean() > 0.9 and (good >= 0.3).mean() > 0.95


def test_quality_keeps_rows_and_columns(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (None, 1), (20, None), (21, 0), (99, 1)], "doc_id long, quality int")
    got = score_quality(odd_docs, labels, F.lit(True))
    assert got.columns == [*odd_docs.columns, "quality_score"] and got.count() == odd_docs.count()
    assert all(0 <= r["quality_score"] <= 1 for r in got.collect())
    own = score_quality(odd_docs, labels, F.lit(True), name="score")  # a column of that name is replaced
    assert own.columns == odd_docs.columns and sorted(r["score"] for r in own.collect()) == sorted(r["quality_score"] for r in got.collect())


def plain_features(text):
    """Trigram buckets and shares of one text, byte by byte."""
    raw = (text or "").encode()
    counts = np.zeros(quality.BUCKETS)
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        counts[(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    size, n = max(1, len(raw)), max(1, len(w))
    symbol = sum(32 < x < 48 or 57 < x < 65 or 90 < x < 97 or 122 < x < 128 for x in raw)
    shares = [sum(65 <= x <= 90 for x in raw) / size, sum(48 <= x <= 57 for x in raw) / size, symbol / size, 1 - len(set(w)) / n, min(len(w) / 100, 1), min(size / n / 20, 1)]
    return counts, np.array(shares)


def test_quality_equals_plain_voting(spark, some):
    """Every document against every labelled vector, one by one; copies make ties."""
    docs = table(spark, some, "documents").filter("doc_id < 150").select("doc_id", "text")
    docs = materialize(docs.unionByName(docs.filter("doc_id < 90").withColumn("doc_id", F.col("doc_id") + 1000)), "copies")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in [*range(0, 150, 2), *range(1000, 1090)]], "doc_id long, quality int")
    space = quality.fit(docs, labels, F.lit(True))
    rows = docs.collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    labelled = [(i, y) for i, y in sorted((r["doc_id"], r["quality"]) for r in labels.collect()) if i in texts]
    assert space.labels.tolist() == [y for _, y in labelled]
    place = lambda text: space.place(*[x[None] for x in plain_features(text)])[0]
    vectors = [place(texts[i]) for i, _ in labelled]
    n_good = sum(y for _, y in labelled)
    assert {float(w) for w in space.weights} == {1.0} and 0 < n_good < len(labelled)
    want = {}
    for i, text in texts.items():
        v = place(text)
        cosines = [round(float(v @ u) / quality.STEP) for u in vectors]
        near = sorted(range(len(vectors)), key=lambda j: (-cosines[j], j))[: quality.NEIGHBOURS]
        weight = [max(cosines[j] * quality.STEP, 1e-6) ** 4 for j in near]
        want[i] = sum(w * labelled[j][1] for w, j in zip(weight, near, strict=True)) / sum(weight)
    scores = [{r["doc_id"]: r["quality_score"] for r in quality.score_quality(docs.repartition(n, "text"), labels, F.lit(True)).collect()} for n in (1, 7)]
    assert scores[0] == scores[1]
    assert all(abs(scores[0][i] - x) < 1e-9 for i, x in want.items())


def test_languages_held_out(spark, some):
    docs = table(spark, some, "documents")
    got = identify_languages(docs, fold(F.col("doc_id")) != 0).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.filter(fold(F.col("doc_id")) == 0).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_mixtures(spark, some):
    docs = table(spark, some, "documents").filter("lang in ('en', 'de') and n_chars between 1500 and 4000")
    one = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.max_by("text", F.xxhash64("doc_id")).alias("text")).collect()}
    mixed = spark.createDataFrame([(-1, one["en"][:1500] + "\n" + one["de"][:1500], None)], "doc_id long, text string, lang string")
    whole = table(spark, some, "documents").select("doc_id", "text", "lang").unionByName(mixed)
    got = identify_languages(whole, F.lit(True)).filter("doc_id = -1").first()
    assert {x["lang"] for x in got["languages"]} == {"de", "en"} and 0.35 < got["score"] < 0.65
    assert abs(sum(x["share"] for x in got["languages"]) - 1) < 1e-6


def test_all_languages_and_large_sets(spark):
    """More than 64 languages, the small ones too, and a text in five of them."""
    rng = random.Random(8)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for _ in range(80)]
    say = lambda i, n: " ".join(rng.choice(vocabulary[i]) for _ in range(n))
    rows = [(i, say(i, 40 if i % 2 else 80), f"l{i:02}") for i in range(80)]
    rows += [(100 + i, say(i, 30), None) for i in range(80)]
    rows += [(-1, " ".join(say(i, 60) for i in (1, 2, 30, 55, 79)), None)]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 100).collect()}
    assert all(got[100 + i]["lang_pred"] == f"l{i:02}" for i in range(80))
    assert {x["lang"] for x in got[-1]["languages"]} == {"l01", "l02", "l30", "l55", "l79"}


def test_languages_odd(odd_docs):
    got = {r["doc_id"]: r for r in identify_languages(odd_docs, F.lit(True)).collect()}
    assert {got[i]["lang_pred"] for i in (4, 5, 6, 11)} == {"und"} and got[10]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_rules_equal_brute_force(odd_docs, no_docs):
    got = rules.apply_rules(odd_docs).collect()
    want = []
    for r in odd_docs.collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + d for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((r["doc_id"], len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in got)
    assert all(not r["kept"] for r in got if r["base_failed"]) and rules.apply_rules(no_docs).count() == 0


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    moves = rng.normal(size=(2, 2))
    row = np.repeat([0, 1, 2, 5], [1, 4, 7, 3])
    score = rng.normal(size=len(row)) * 2
    label = rules.viterbi(row, score, moves)
    worth = lambda y, s: sum(s[i] for i in range(len(y)) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
    for r in np.unique(row):
        own = score[row == r]
        best = max(product((0, 1), repeat=len(own)), key=lambda y: worth(y, own))
        assert tuple(label[row == r].tolist()) == best


def test_field_learns_its_labels():
    rng = np.random.default_rng(6)
    row = np.repeat(np.arange(100), 6)
    y = np.repeat(rng.integers(0, 2, 200), 3)
    x = np.zeros((600, len(rules.FEATURES)))
    x[:, 0] = 1
    x[:, 4] = np.where(rng.random(600) < 0.1, 1 - y, y)
    weights, moves = rules.train_field(row, x, y)
    assert np.mean(rules.viterbi(row, x @ weights, moves) == y) > 0.9


def test_boilerplate_goes_and_content_stays(spark):
    rng = random.Random(4)
    calm = "\n".join(prose(rng, 12) + "." for _ in range(8))
    junk = "\n".join(" ".join(f"{rng.choice('#*$%&|<>')}{rng.randrange(10**6)}{rng.choice('#*$%&')}{rng.choice('#*$%&')}" for _ in range(9)) for _ in range(12))
    got = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame([(1, calm), (2, junk)], "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["line_labels"] == "C" * 8 and not got[2]["kept"]
