import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that the operators use for columns of their own.
CLASH = "digest long, size string, h double, target string, label int, cls string, keys string, row string, html int, span int, k_id int, n long, word int, taken string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"wort{k * 7919 % 9973} und" for k in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs on", "en", "a", 55), (1, "the quick brown fox jumps over the lazy dog and runs on", "en", "a", 55), (2, "the quick brown fox jumps over the lazy dog and runs on", "en", "b", 55),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "de", None, 3), (None, "nur ein kleiner satz ohne nummer hier", "de", "b", None), (6, long, "de", "a", len(long)), (7, long, None, "b", len(long)),
        (8, "word", "en", "a", 4), (9, "éèê \U0001f600\U0001f600 中文", "fr", "c", 8), (10, "12345 !!! ???", "en", "c", 13), (10, "another text of the same id that is longer than the first", "en", "c", 58),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for f in T._parse_datatype_string(CLASH).fields:
        from pyspark.sql import functions as F

        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
