import pytest


@pytest.fixture()
def docs(spark):
    """Frame of (doc_id, text, lang, source, n_chars) rows from (doc_id, text[, source]) tuples."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return make
