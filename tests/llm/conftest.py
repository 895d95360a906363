import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts, parts=3):
        rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded random words from a small vocabulary."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make


#: Texts that every operator must take: null, empty, blank, one word, very long, repeated.
ODD = [None, "", " \n\t", "one", "x" * 200_000, "same text twice", "same text twice", "ünï çødé 中文\x00\x0b", "word " * 30_000]
