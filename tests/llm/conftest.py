import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture()
def docs(spark):
    """Rows (id, text, lang, source) as a table of documents, with further columns that clash with inner names."""

    def make(rows, clash=True, parts=3):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        if clash:
            for name in ("h", "n", "k1", "drop", "row", "key", "class", "spans", "kept", "loss", "n_words", "root", "place", "of"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "one", None, None),
    (4, "tie tie tie\ntie tie tie\n\n", "en", "b"),
    (5, "same text in two rows, with a few words more than five", "en", "a"),
    (5, "same text in two rows, with a few words more than five", "en", "a"),
    (None, "no id", "fr", "c"),
    (7, "long " * 30_000, "en", "a"),
    (8, "éè 日本 \U0001f600 \x00\x01", "fr", "c"),
]


@pytest.fixture()
def edge(docs):
    return docs(EDGE)


@pytest.fixture()
def empty(docs):
    return docs([])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
