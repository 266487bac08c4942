import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text) as a documents table."""
    from storelytics.llm.common import tune

    tune(spark)

    def make(*rows):
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
