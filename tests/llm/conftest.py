import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A frame of documents from texts or (doc_id, text) pairs."""

    def make(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame(
            [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCUMENTS
        )
        # columns whose names the operators use themselves
        return frame.selectExpr("*", "1 AS node", "2 AS signature", "'x' AS size", "3 AS `key`", "4 AS place") if extra else frame

    return make
