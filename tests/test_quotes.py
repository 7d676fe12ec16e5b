"""Quotes in texts against a plain search."""

import pytest

from parlance.functions import text

DOCS = [(1, "He said “Stop   that” and left"), (2, ""), (3, None), (None, "stop that stop that"), (1, "op th"), (4, "nothing")]
QUOTES = [("a", "stop that"), ("b", "OP TH"), ("a", "stop that"), ("c", ""), ("d", None), (None, "left"), ("e", "absent")]


@pytest.mark.parametrize("most", [1 << 22, 4])
def test_every_quote_is_found(spark, most):
    docs, quotes = spark.createDataFrame(DOCS, "d int, x string"), spark.createDataFrame(QUOTES, "q string, y string")
    found = text.quoted(docs, "d", "x", quotes, "q", "y", most)
    plain = lambda s: " ".join(s.replace("“", '"').replace("”", '"').lower().split())
    want = [(d, q) for d, x in DOCS for q, y in QUOTES if x is not None and y is not None and plain(y) in plain(x)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.columns == ["d", "q"] and [t for _, t in found.dtypes] == ["int", "string"]


def test_empty_tables(spark):
    docs, quotes = spark.createDataFrame(DOCS, "d int, x string"), spark.createDataFrame(QUOTES, "q string, y string")
    assert text.quoted(docs, "d", "x", quotes.where("false"), "q", "y").count() == 0
    assert text.quoted(docs.where("false"), "d", "x", quotes, "q", "y").count() == 0
