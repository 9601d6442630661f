import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty and blank texts, repeated rows, ties, one very long text, control characters.
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "b", 3),
       (4, "one", "en", "b", 3), (5, "x\x00y  z  café ́a \U0001f600", "fr", None, 20),
       (6, "word " * 30_000, "en", "a", 150_000), (7, "a" * 50_000, "de", "c", 50_000), (None, "no id here", "en", "a", 10)]


@pytest.fixture()
def odd(spark):
    """Awkward rows, with extra columns whose names clash with results."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DOCS).withColumns(
        {c: F.lit("clash") for c in ("score", "kept", "spans", "sequence_id", "size", "word", "start", "u", "component_id")})


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)
