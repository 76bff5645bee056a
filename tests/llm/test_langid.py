"""Operator 8 against a plain expectation maximisation, document by document."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lexsift.llm.common import table
from lexsift.llm.langid import BITS, identify_languages, proportions

LETTERS = {i: i for i in [*range(97, 123), *range(128, 256)]} | {i: i + 32 for i in range(65, 91)}


def plain_trigrams(text):
    """How often each bucket comes, byte by byte; two spaces stand before and after the text."""
    raw = [32, 32, *[LETTERS.get(b, 32) for b in (text or "").encode()], 32, 32]
    found = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if (a, b, c) != (32, 32, 32):
            found[(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - BITS)] += 1
    return found


def plain_em(p, counts, share, turns):
    for _ in range(turns):
        joint = p * share
        share = (counts[:, None] * joint / joint.sum(1)[:, None]).sum(0) / counts.sum()
    return share


def worth(log, counts, langs, share):
    """The penalised likelihood of a mixture of ``langs``."""
    likelihood = (np.log(np.exp(log[:, langs]) @ share) * counts).sum()
    return likelihood - (len(langs) - 1) * np.log(max(counts.sum(), 2)) / 2


def plain_choice(log, counts):
    """(penalised likelihood, share of each language): every size is tried, without a bound."""
    n = log.shape[1]
    one = max(range(n), key=lambda j: (log[:, j] @ counts, -j))
    best, chosen = log[:, one] @ counts, np.eye(n)[one]
    full = plain_em(np.exp(log), counts, np.full(n, 1 / n), 12)
    order = sorted(range(n), key=lambda j: -full[j])
    for size in range(2, n + 1):
        langs = order[:size]
        share = full[langs] + 1e-9
        share = plain_em(np.exp(log[:, langs]), counts, share / share.sum(), 6)
        got = worth(log, counts, langs, share)
        if got > best:
            best, chosen = got, np.zeros(n)
            chosen[langs] = share
    return best, chosen


def test_proportions_equal_plain_em():
    """Texts of one to three of five languages; the set is held against all 31 as well."""
    rng = np.random.default_rng(12)
    words = rng.dirichlet(np.full(60, 0.4), 5) + 1e-4
    words /= words.sum(1, keepdims=True)
    log = np.log(words.T).astype(np.float32)
    rows, buckets, docs = [], [], 120
    for i in range(docs):
        own = rng.choice(5, 1 + i % 3, replace=False)
        drawn = np.concatenate([rng.choice(60, 150, p=words[j]) for j in own])
        rows.append(np.full(len(drawn), i))
        buckets.append(drawn)
    got = proportions(np.concatenate(rows), np.concatenate(buckets), docs + 1, log)
    assert not got[docs].any()  # a text of no trigrams
    as_good = 0
    for i in range(docs):
        at, counts = np.unique(buckets[i], return_counts=True)
        own = log[at].astype(np.float64)
        best, want = plain_choice(own, counts.astype(float))
        assert np.allclose(got[i], want, atol=1e-9)
        sets = [list(s) for size in range(1, 6) for s in combinations(range(5), size)]
        every = max(worth(own, counts, s, plain_em(np.exp(own[:, s]), counts, np.full(len(s), 1 / len(s)), 100)) for s in sets)
        as_good += best > every - 1  # rounds are few, so shares are a little off their best
    assert as_good == docs


def test_languages_equal_plain_inference(spark, some):
    """Whole query: counts, mixtures and the language of every document, learned from or not."""
    docs = table(spark, some, "documents").filter("doc_id < 150").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 34 !", "de"), (-4, "Ünder", None)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 20"))
    rows = docs.collect()
    learned = defaultdict(Counter)
    for r in rows:
        if r["doc_id"] % 3 and r["lang"] is not None:
            learned[r["lang"]].update(plain_trigrams(r["text"]))
    langs = sorted(lang for lang, found in learned.items() if found)
    counts = np.full((1 << BITS, len(langs)), 0.1)
    for j, lang in enumerate(langs):
        for b, n in learned[lang].items():
            counts[b, j] += n
    log = np.log(counts / counts.sum(0)).astype(np.float32).astype(np.float64)
    want = []
    for r in rows:
        found = plain_trigrams(r["text"])
        known = any(map(str.isalpha, r["text"] or ""))
        share = plain_choice(log[list(found)], np.array(list(found.values()), float))[1] if known else np.zeros(len(langs))
        want.append((r["doc_id"], langs[int(share.argmax())] if known else "und", round(float(share.max()), 6)))
    got = identify_languages(docs.repartition(5), F.col("doc_id") % 3 != 0).collect()
    assert sorted(want) == sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got)
