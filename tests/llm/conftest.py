import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = ["ta", "re", "mo", "lin", "que", "sor", "vi", "na", "pel", "dun"]


def prose(seed: int, words: int) -> str:
    """Invented words, different for every seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) rows, over several partitions."""

    def f(rows, parts=3):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(parts)

    return f


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    a = prose(1, 120)
    return make([(1, a), (2, a), (2, a), (3, None), (4, None), (None, a), (None, None), (5, ""), (6, ""), (7, "x"), (8, prose(2, 30000)), (9, "!!! ???")])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
