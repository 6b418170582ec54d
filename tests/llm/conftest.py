import pytest


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, over several partitions."""

    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)

    return make
