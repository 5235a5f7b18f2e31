import pytest

#: Extra columns that operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, ids string, n int, batch int"


@pytest.fixture()
def docs(spark):
    """Makes documents from (doc_id, text) pairs with extra columns of clashing names."""

    def make(*rows):
        full = [(i, t, None if k % 3 == 2 else "en", None if k % 4 == 3 else "src0", None if t is None else len(t), "k", 0.5, "i", k, 7) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make
