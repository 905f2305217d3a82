import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns that clash with working names."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in rows]
        kind = "doc_id long, text string, lang string, source string, n_chars long, bucket int, part string"
        return spark.createDataFrame(full, kind)

    return make
