import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash with
    those that operators make."""
    def make(rows):
        full = [(i, t, "en", "src", len(t or ""), 1, "x", 2.0) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA + ", row int, digest string, score double")
    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
