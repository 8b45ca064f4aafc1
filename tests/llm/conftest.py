import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, or of (doc_id, text)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def small(spark):
    from tests.conftest import SMALL

    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


#: Null, empty, blank, one word, repeated rows, odd characters, a long text, no id.
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "word"), (3, "word"), (4, "Ünïcødé 🙂 \x00 x"), (5, "lorem ipsum dolor " * 20000), (None, "no id at all here"), (6, "a" * 300000)]
