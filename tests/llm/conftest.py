from __future__ import annotations

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text) rows."""
    return lambda rows: spark.createDataFrame([(i, x, "en", "s", None if x is None else len(x)) for i, x in rows], DOCS)


@pytest.fixture(scope="session")
def texts(tiny):
    """Rows of the smallest documents table."""
    return duckdb.sql(f"select doc_id, text from '{tiny}/documents.parquet' order by doc_id").fetchall()


#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, equal texts, no white space, non-ASCII.
ODD = [(1, None), (2, ""), (3, "  \\n\\n "), (4, "word"), (4, "word"), (None, "a null id has a text too"), (5, "same text in two rows " * 20), (6, "same text in two rows " * 20), (7, "x" * 5000), (8, "日本語 ünïcödé é \\x00 end"), (9, "l1\\nl2\\nl1\\nl2")]


@pytest.fixture(scope="session")
def odd():
    return [(i, x if x is None else x.encode().decode("unicode_escape") if "\\" in x and x.isascii() else x) for i, x in ODD]
