import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("rep", T.LongType()), ("h", T.StringType()), ("k1", T.StringType()))])


def words(seed, n):
    import random

    r = random.Random(seed)
    return [r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstuv") + str(r.randint(0, 99)) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows; columns rep, h and k1 clash with names used inside."""
    long = " ".join(words(5, 30_000))
    near = words(1, 200)
    texts = [None, "", " \n\n ", "one", long, " ".join(near), " ".join(near), " ".join(near[:100] + ["changed"] + near[101:]), "a b c\nd e f\ng h i\nj", "x\na b c\nd e f\ng h i\ny", "aé\U0001f600 ñ"]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "h", "k") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "null id", None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
