import pytest


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) pairs, with columns that operators also use inside."""

    def make(rows, **more):
        names = ["doc_id", "text", "lang", "source", "n_chars", "kept", "fp", "at"]
        full = [(i, t, "en", more.get("source", "s"), None if t is None else len(t), 7, 8, 9) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept int, fp int, at int").select(*names)

    return make
