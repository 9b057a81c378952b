import pytest


@pytest.fixture()
def docs(spark):
    """Documents with the columns of the table and one more, from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(i, t, *(more or ("en",)), "src0", len(t or ""), "x") for i, t, *more in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")

    return make


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of tables: the smallest real ones."""
    return "/root/testdata/sf0.001"
