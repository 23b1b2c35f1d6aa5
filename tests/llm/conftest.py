import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, other columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "b", 1, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "y"),
        (4, words, "en", "a", 3, "z"),
        (5, words, "de", "a", 3, "z"),
        (6, words.replace("w1500 ", "changed "), "de", None, 3, "z"),
        (6, words.replace("w1500 ", "changed "), "de", None, 3, "z"),
        (7, "ab " * 60, "en", "b", 1, "q"),
        (None, "no id here but some words of text", "en", "c", 1, "q"),
        (8, "\n\t \n", "en", "c", 1, "q"),
        (9, "é😀" * 400, "en", "c", 1, "q"),
    ]
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("id", T.StringType())]
    schema = T.StructType([T.StructField(n, k) for n, k in fields])
    return spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
