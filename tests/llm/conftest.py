import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, rank int, ids string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, lang]) with extra columns whose names clash with results."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, -1.0, "x", 0, "y") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


ODD = [(1, ""), (2, None), (3, " \n\t"), (4, "one"), (5, "One"), (None, "one"), (6, "word " * 5000), (6, "word " * 5000),
       (7, "é ü 漢字 😀"), (8, "a b c"), (9, "A  B\nC"), (10, "x" * 20000)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return list(ODD)
