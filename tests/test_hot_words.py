from scholia.operators.hot_words import Vocabulary, hot_words, hot_words_by_year, year_terms
from scholia.operators.index import normalise


def test_canonical():
    v = Vocabulary()
    assert v.canonical("large language models and graph neural network cnns".split()) == ["llm", "and", "gnn", "cnn"]
    assert v.canonical("graph convolutional networks graph".split()) == ["gcn", "graph"]
    more = v.with_aliases(["# x => y", "machine learning => ml", "a b => ab", "b c d => bcd", "gpt => chat"])
    assert more.canonical("a b c d".split()) == ["ab", "c", "d"] and more.canonical("b c d".split()) == ["bcd"]
    assert more.canonical(["gpt"]) == ["chat"] and more.canonical(["machine", "learning"]) == ["ml"]
    assert "term" in v.with_stopwords(["short term", "#no"]).stopwords and "no" not in v.with_stopwords(["#no"]).stopwords


def test_counts(spark):
    rows = [(0, "Graph Neural Networks and graphs 2020", "", 2020), (1, "GNNs", "", 2020), (2, "", "", 2020), (3, "graphs a x1", "", 2021)]
    d = normalise(spark.createDataFrame(rows, "doc_id long, title string, journal string, year int"))
    assert {(r["year"], r["term"], r["freq"]) for r in year_terms(d).collect()} == {(2020, "gnn", 2), (2020, "graphs", 1), (2021, "graphs", 1), (2021, "x1", 1)}
    assert [r["term"] for r in hot_words(d, 2020).collect()] == ["gnn", "graphs"]
    assert hot_words_by_year(d, 1).count() == 2
