import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts; ids from 0, or pairs of id and text."""

    def make(texts, lang=lambda k: "en"):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang(k), "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)

    return make
