import pytest


@pytest.fixture
def documents(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return make


@pytest.fixture
def texts(documents):
    def make(items):
        return documents([(k, t, "en", "s", len(t or "")) for k, t in items])

    return make
