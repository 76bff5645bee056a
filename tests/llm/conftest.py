import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Extra columns whose names operators might use themselves.
EXTRA = "size long, row_id long, h long, shard int, label int, score double, n long, key string, at int, target double, d1 long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 120)
    near = same.split()
    near[60] = "changed"
    rows = [
        (1, same, "en", "a"), (2, same, "en", "b"), (2, same, "en", "b"), (3, " ".join(near), "en", "a"), (4, None, "en", "a"), (5, "", None, None),
        (6, " \n\t ", "de", "b"), (7, long, "en", "a"), (None, "a text of no id at all", None, None), (None, None, None, None),
        (8, "two words", "fr", None), (9, "two  WORDS", "fr", "c"), (10, "été été été\nété", "fr", "c"), (11, "1234 5678", None, "c"),
    ]
    rows += [(20 + i, prose(rng, 60 + i), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(30)]
    data = [(i, t, lang, src, len(t) if t is not None else None, 1, 2, 3, 4, 5, 0.5, 7, "k", 8, 1.5, 9) for i, t, lang, src in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return _stored(spark, data, schema)


def _stored(spark, data, schema):
    from lexsift.llm.common import materialize

    return materialize(spark.createDataFrame(data, schema).repartition(3), "odd")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def some(spark):
    return "/root/testdata/sf0.01"
