import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given (doc_id, text) rows."""
    def make(rows, **more):
        full = [(i, t, "en", more.get("source", "s"), None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return make
