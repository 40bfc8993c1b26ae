import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use themselves
                     T.StructField("node", T.LongType()), T.StructField("size", T.LongType()),
                     T.StructField("score", T.DoubleType()), T.StructField("_at", T.LongType())])

LONG = "Lorem ipsum, dolor sit amet consetetur. " * 5000
ODD_TEXTS = [None, "", " \t\n", "One", "a b c", "a b c", LONG, "ÀÉ \u00a0x\x1cy\n\n\nz", "İstanbul 中文 😀!"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, partitions=3):
        """rows: (doc_id, text[, source])."""
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None,
                 None if r[1] is None else len(r[1]), 1, 2, 0.5, 4) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls everywhere, empty and very long texts, repeated rows."""
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(ODD_TEXTS)]
    return make_docs(rows + [rows[3], (None, "nameless text here", None), (None, None, "s")])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
