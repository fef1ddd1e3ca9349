import pytest


@pytest.fixture
def docs(spark):
    """Builds a small table of documents; extra columns have names that operators use themselves."""

    def build(texts, ids=None, **extra):
        rows = [(i if ids is None else ids[i], t, "en", f"s{i % 2}", None if t is None else len(t), "x", 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n long")

    return build
