import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.functions import text

CASES = {
    "Hello, World-Wide_web's 2x": ["hello", "world", "wide_web", "s", "2x"],
    "M&uuml;ller": ["m", "uuml", "ller"],
    "M&#233;thodes": ["méthodes"],
    "&#65;b &#x42;": ["Ab", "B"],
    "a&#32;b": ["a", "b"],
    "É—é x": ["É—é x"],
    "A &amp; B": ["a", "&", "b"],
    "&amp;&lt;x&gt;": ["&<x>"],
    "&#55296;x &#1114112; &#999999999;": ["55296", "x", "1114112", "999999999"],
    "a & b &; &amp": ["a", "b", "amp"],
    "": [],
    None: [],
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", text.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r["x"] == CASES[r["t"]], r["t"]
        assert r["t"] is None or text.py_tokens(r["t"]) == CASES[r["t"]], r["t"]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_py_tokens_hold_no_separators(s):
    for t in text.py_tokens(s.replace("&", "")):
        assert t and not any(ord(c) < 128 and not (c.isalnum() or c == "_") for c in t)


def test_scalars(spark):
    df = spark.createDataFrame([("é", "e"), ("abcd", "abxd"), ("abc", "xyzzy")], "a string, b string")
    got = df.select(text.byte_levenshtein(F.col("a"), F.col("b"), 2).alias("d"), F.size(text.trigrams(F.col("a"))).alias("g")).collect()
    assert [tuple(r) for r in got] == [(2, 0), (1, 2), (-1, 1)]
    years = spark.createDataFrame([("abc",), ("-5",), ("99999999999",), ("2020x",), ("",)], "y string").select(text.year_of(F.col("y"))).collect()
    assert [r[0] for r in years] == [0, -5, 0, 2020, 0]
    assert spark.range(1).select(text.xml_decode(F.lit("&amp;lt; &lt;"))).first()[0] == "&lt; <"
    boosts = spark.createDataFrame([(i,) for i in range(4)], "d int").select(text.distance_boost(F.col("d"))).collect()
    assert [r[0] for r in boosts] == [1.0, 0.72, 0.45, 0.25]
    penalties = spark.createDataFrame([(0.3,), (0.15,), (0.05,), (0.01,)], "d double").select(text.df_penalty(F.col("d"))).collect()
    assert [r[0] for r in penalties] == pytest.approx([0.2, 0.4, 0.65, 1.0])
