import pytest
from pyspark.sql import functions as F

from scholia.operators import lookup
from scholia.operators.index import build_index, load_index, save_index
from scholia.operators.search import search, total_hits
from scholia.plans.search_plan import parse_author, parse_search
from scholia.suite import SHAPES, run_suite, summary

DOCS = [
    (0, "Deep learning for graphs", ["Ann Lee", "Bo Chen"], "V", 2020),
    (1, "Graph neural networks", ["Ann Lee"], "W", 2021),
    (2, "Neural learning, deep", ["Cy Dole", "Cy Dole"], "V", 2019),
    (3, "", ["Bo Chen"], "V", 2018),
    (4, "Deep learning", None, None, None),
    (5, "Learning deep", ["ann lee"], "V", 2021),
]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id long, title string, authors array<string>, journal string, year int"))


def test_grammar():
    p = parse_search('"deep Learning" graph* ~eur~ ~ab~ mode:and sort:newest fuzzy:9 fuzzyexp:99 page:2 size:5 limit:7 offset:3 and x')
    assert p.phrases == [["deep", "learning"]] and p.prefixes == ["graph"] and p.substrings == ["eur"] and p.ignored_substrings == ["ab"]
    assert (p.mode, p.sort, p.fuzzy, p.max_edits, p.expansions) == ("and", "newest", True, 2, 12)
    assert (p.page, p.size, p.limit, p.offset) == (2, 5, 7, 3) and p.terms == ["deep", "learning", "x"]
    assert parse_search("a and b").mode == "and" and parse_search("a and b or c").mode == "or" and parse_search("a b").mode == "or"
    assert parse_search("mode:or a and b").mode == "or" and not parse_search("fuzzy:off x").fuzzy
    assert parse_search("page:9 size:10").window(25) == (20, 10) and parse_search("limit:0").window(9) == (0, None)
    a = parse_author("fuzzy:1 Ann  LEE")
    assert (a.author, a.fuzzy, a.max_edits) == ("ann lee", True, 1)


def ids(index, query):
    return [r["doc_id"] for r in search(index, query)[0].orderBy("rank").collect()]


def test_modes(index):
    assert set(ids(index, "deep learning fuzzy:off")) == {0, 2, 4, 5}
    assert set(ids(index, "deep graph mode:and fuzzy:off")) == set()
    assert set(ids(index, "deep graphs mode:and fuzzy:off")) == {0}
    assert ids(index, '"deep learning" fuzzy:off')[:2] == [4, 0]
    assert set(ids(index, "neur* fuzzy:off")) == {1, 2} and set(ids(index, "~raph~ fuzzy:off")) == {0, 1}
    newest = ids(index, "learning sort:newest fuzzy:off")
    assert newest[0] == 5 and newest[-1] == 4
    assert ids(index, "lerning deep fuzzy:2")[0] in (4, 5)
    assert ids(index, "zzzz fuzzy:off") == [] and ids(index, "deep zzzz mode:and") == []


def test_pages_join_to_the_whole(index):
    whole = [r["doc_id"] for r in search(index, "deep learning neural limit:0 fuzzy:off")[0].collect()]
    paged = ids(index, "deep learning neural page:1 size:2 fuzzy:off") + ids(index, "deep learning neural page:2 size:2 fuzzy:off") + ids(index, "deep learning neural page:3 size:2 fuzzy:off")
    assert paged == whole and len(whole) == 5
    assert ids(index, "deep learning neural page:9 size:2 fuzzy:off") == whole[4:]
    assert total_hits(index, "deep learning neural fuzzy:off").first()[0] == 5
    assert set(ids(index, "deep learning mode:and fuzzy:off")) <= set(ids(index, "deep learning mode:or fuzzy:off"))


def test_stored_index_answers_alike(spark, index, tmp_path):
    path = str(tmp_path / "index")
    save_index(index, path, "v1")
    stored = load_index(spark, path, "v1")
    assert load_index(spark, path, "v2") is None and load_index(spark, str(tmp_path / "none")) is None
    for q in ("deep learning fuzzy:off", "neur* deep fuzzy:off", '"deep learning" graphs', "deap learning", "deep learning mode:and"):
        a, b = search(index, q)[0].select("doc_id", F.round("score", 6)).collect(), search(stored, q)[0].select("doc_id", F.round("score", 6)).collect()
        assert a == b, q
    assert sorted(r["doc_id"] for r in lookup.by_author(stored, "Ann Lee")[0].collect()) == [0, 1, 5]


def test_lookup(index):
    assert sorted(r["doc_id"] for r in lookup.by_author(index, "ANN lee")[0].collect()) == [0, 1, 5]
    found, near = lookup.by_author(index, "ann leee")
    assert near[0] == "ann lee" and found.count() == 3
    assert lookup.by_author(index, "ann leee fuzzy:off")[0].count() == 0
    assert [r["doc_id"] for r in lookup.by_title(index, "deep LEARNING!").collect()] == [r["doc_id"] for r in lookup.by_title_terms(index, "deep LEARNING!").collect()] == [4]
    assert [(r["author_key"], r["author_raw"], r["papers"]) for r in lookup.collaborators(index.authors, "ann lee").collect()] == [("bo chen", "Bo Chen", 1)]
    assert [(r["author_key"], r["n"]) for r in lookup.top_authors(index.authors).collect()] == [("ann lee", 3), ("cy dole", 2), ("bo chen", 2)]


def test_suite(spark, index):
    words = ("deep", "learning", "graph", "neur", "lerning")
    results = run_suite(index, [(i, c, q.format(*words)) for i, c, q in SHAPES] + [("bad", "empty", "")])
    assert [r.ok for r in results] == [True] * len(SHAPES) + [False]
    assert summary(spark, results).first()["n"] == len(SHAPES) + 1
