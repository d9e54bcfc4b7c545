import os

import pytest

import logtide.llm  # noqa: F401
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "keep_id", "digest", "row", "part", "_doc", "_cut", "_pii", "id", "key", "fp", "_host", "_group", "words", "kept",
)
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
TEXTS = [
    "One two  three.\nFour five six\nseven", "one two three.\nfour five six\nseven", "", None, "   \n\t ", "a",
    "One two three.\nFour five six seven", LONG, "Ünïcode ½ ² 日本語 🙂 é́  double  space \n x", "One two  three.\nFour five six\nseven",
]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, or (doc_id, text[, source]) rows, with columns whose names clash."""

    def table(rows, clash=False):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, source = (i, r, "s") if not isinstance(r, tuple) else (*r, "s")[:3]
            full.append((doc_id, text, None if i % 3 else "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
        return df

    return table


@pytest.fixture(scope="session")
def odd(make):
    """Null ids, texts and sources, empty and long texts, repeated ids and rows, clashing names."""
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", "s"), (None, None, None), (3, "another text of id 3", "s"), (0, TEXTS[0], None)]
    return make(rows, clash=True)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]


def same(rows, wanted):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, wanted), key=key)


@pytest.fixture(scope="session")
def equal():
    return same


__all__ = ["Row"]
