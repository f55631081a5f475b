import pytest

from tests.llm.helpers import odd_rows, table_rows


@pytest.fixture(scope="session")
def llm(spark):
    from millrace.llm.common import prepare
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd(llm):
    """Documents of the smallest table and rows that try the limits, with extra
    columns whose names clash with results."""
    rows = table_rows() + odd_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long, chunk int, block string, size string, kept string, node string"
    return llm.createDataFrame([(*r, 7, "x", "y", "z", "w") for r in rows], schema), rows


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
