import pytest
from pyspark.sql import types as T

SHAPE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                      T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                      T.StructField("_t", T.StringType()), T.StructField("label", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) rows, with columns whose names clash with working columns."""
    def make(rows):
        full = [(i, t, "en", None if k % 3 == 0 else "src0", None if t is None else len(t), "x", k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SHAPE)
    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, an empty and a very long text, ties, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return make_docs([(1, "the quick brown fox jumps over the lazy dog and runs away"), (1, "the quick brown fox jumps over the lazy dog and runs away"),
                      (2, None), (3, ""), (None, "text of nobody stands here"), (None, None), (4, long), (5, " \n\t "), (6, "x" * 50_000),
                      (7, "the quick brown fox jumps over the lazy dog and runs away"), (-3, "ünï cödé 日本 e\u0301")])


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 1, None), (6, 0, 1), (6, 0, 1), (99, 1, 1)], LABELS)
