import pytest


@pytest.fixture
def docs(spark):
    """A maker of documents tables from texts."""

    def make(*texts, ids=None, extra=True):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return df if extra else df.select("doc_id", "text")

    return make
