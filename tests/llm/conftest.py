import pandas as pd
import pytest


@pytest.fixture
def table(spark):
    """A table with every column that a document has, and columns whose names operators use inside."""

    def make(texts, ids=None, sources=None, langs=None):
        n = len(texts)
        rows = pd.DataFrame({"doc_id": pd.array(ids if ids is not None else range(n), dtype="Int64"), "text": texts, "lang": langs or ["en"] * n, "source": sources or ["s"] * n, "n_chars": [len(t or "") for t in texts]})
        rows = [(None if i is pd.NA else int(i), t, la, s, c, "x", "y", "z", "w") for i, t, la, s, c in rows.itertuples(index=False)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, mix string, language string, bpe string")

    return make
