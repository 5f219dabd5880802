from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Makes a table of documents from texts (or (id, text) pairs), with a column that clashes with
    names used inside the operators."""
    def make(*texts, first: int = 0):
        rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "'x' as c", "1 as label", "'y' as spans", "2 as k")
    return make


def words(n: int, seed: int = 0) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
