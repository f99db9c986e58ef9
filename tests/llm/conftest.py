import pytest


@pytest.fixture
def docs_of(spark):
    """A table of documents from (doc_id, text) rows, with extra columns whose names clash with those that operators use."""

    def make(rows, schema="doc_id long, text string"):
        more = "label string, rank int, length int, score double, did int, th int, covers int, host string, license string, n_tokens int, ids int, fp int, kept int"
        return spark.createDataFrame([(i, t, "x", 1, 2, None, 3, 4, 5, "h", "l", 6, 7, 8, 9) for i, t in rows], f"{schema}, {more}")

    return make
