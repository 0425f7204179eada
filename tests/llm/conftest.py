import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, lang, source) rows, with an extra clashing column."""

    def make(rows, extra=None):
        full = [(r + (None,) * 4)[:4] for r in rows]
        data = [(*r, None if r[1] is None else len(r[1])) for r in full]
        df = spark.createDataFrame(data, SCHEMA)
        return df.selectExpr("*", f"'x' as {extra}") if extra else df

    return make


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]
