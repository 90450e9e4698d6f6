import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 20_000
SENTENCE = "the quick brown fox jumps over the lazy dog while twelve pale moons rise above the quiet harbour town"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (1, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", "a", 5), (3, None, None, None, None), (4, "", "", "", 0), (None, "no id here", "en", "b", 10),
        (5, LONG, "en", "b", len(LONG)), (6, " \n\t ", None, "a", None), (7, "Ünïcödé 日本語 😀 tëxt\nline\nline", "fr", None, 3), (8, "mail me at jo.doe@example.com or +1 (614) 555-3069 now", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "host", "words", "lines", "spans", "items", "x", "y", "h", "k", "t", "salt", "count", "part", "path", "key", "s", "n", "root", "pieces"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter(F.lit(False))
