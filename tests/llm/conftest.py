import pytest
from pyspark.sql import types as T

from assaylake.llm.common import prepare


@pytest.fixture(scope="session")
def docs(spark):
    """documents rows (doc_id, text[, lang, source]) with a column that clashes with results."""
    prepare(spark)

    def make(*rows):
        layout = T.StructType(
            [
                T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                T.StructField("component_id", T.StringType()),
            ]
        )
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *[None] * (4 - len(row)))
            full.append((doc_id, text, lang, source, len(text or ""), "x", "y"))
        return spark.createDataFrame(full, layout)

    return make


LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty, blank and very long texts, repeated rows and a null source."""
    return docs(
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "de", None), (4, LONG, "en", "b"),
        (5, "same text here\nagain", "en", "b"), (5, "same text here\nagain", "en", "b"), (6, LONG, None, "b"),
    )
