import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, fp string, rule string, key string"


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text[, lang]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None, 7, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
