import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with an extra column whose name an operator uses too."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from trellis.llm.shared import ship

    ship(spark)
