import pytest


@pytest.fixture
def rows(spark):
    """A table of documents from (doc_id, text) pairs, with columns named like
    the operators' own outputs beside them."""
    def make(pairs, **extra):
        data = [(i, t, extra.get("lang", "en"), extra.get("source", "s"), 1, "x", True) for i, t in pairs]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, size int, digest string, kept boolean")
    return make
