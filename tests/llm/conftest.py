import pytest

from claimloom.llm.storage import Workspace

COLUMNS = "doc_id long, text string, lang string, row long, n_words string, _text string"


@pytest.fixture
def ws(spark):
    out = Workspace(spark)
    yield out
    out.close()


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) rows with further columns, some named like those that operators use."""
    return lambda rows: spark.createDataFrame([(i, t, "en", 7, "x", None) for i, t in rows], COLUMNS)
