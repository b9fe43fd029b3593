import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs."""

    def make(rows, extra=""):
        full = [(i, t, "en", "s", len(t or ""), *(["x"] * bool(extra))) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA + (f", {extra} string" if extra else ""))

    return make
