import pytest
from pyspark.sql import types as T

# A clashing extra column for every operator's outputs.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("Node", T.StringType()),
    T.StructField("n_words", T.StringType()), T.StructField("ids", T.StringType()),
])

BASE = " ".join(f"word{i} of the tale" for i in range(60))


def doc(i, text, lang="en"):
    return (i, text, lang, "s", 0.5, "x", "y", "z")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, near copies."""
    rows = [
        doc(1, BASE), doc(2, BASE), doc(2, BASE), doc(3, BASE.replace("word30", "other")), doc(4, None), doc(5, ""), doc(6, "   \n"),
        doc(7, "short text"), doc(8, "short text"), doc(9, "!!! ###"), doc(10, "!!! ###"), doc(None, "no id but a text of its own here"),
        doc(11, " ".join(f"long{i % 977} unit{i}" for i in range(60_000))), doc(12, "ünï cødé 日本 😀 text", None), doc(None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
