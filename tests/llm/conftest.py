import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table, with clashing extra columns on demand."""

    def make(texts, extra=()):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        rows += list(extra)
        return spark.createDataFrame(rows, DOCS)

    return make


#: Texts of odd kinds that every operator on documents must take.
ODD = [None, "", " ", "\n\n", "one", "a b", "word " * 3000, "x" * 30000, "éß \U0001f600 İ Σ \x1c\x85", "tie", "tie", "<|endoftext|> 'S"]
