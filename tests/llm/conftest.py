import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, sum long, word string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with columns whose names the operators use inside."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "src0", None if t is None else len(t), "x", 7, "w") for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated and very long texts, and other alphabets."""
    return [None, "", "   \n", "a", "a", "word " * 60_000, "x" * 100_000, "7" * 50_000, "日本語 テキスト 🙂", "tab\tand more", "same text here", "same text here"]
