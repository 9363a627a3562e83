"""Lookups by author and title, collaborators, and the productivity ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import py_tokens
from scholia.operators.fuzzy import AUTHORS, fuzzy_candidates
from scholia.operators.index import Index, author_lexicon
from scholia.plans.search_plan import parse_author


def papers_of(index: Index, key: str) -> DataFrame:
    """Documents of one author key, one row for each time it is listed."""
    return index.authors.where(F.col("author_key") == key).select("doc_id", "author_raw").join(index.documents, "doc_id")


def fuzzy_authors(index: Index, key: str, max_edits: int = 2) -> DataFrame:
    return fuzzy_candidates(author_lexicon(index.authors), "author_key", "n", key, max_edits, AUTHORS)


def by_author(index: Index, query: str) -> tuple[DataFrame, list[str]]:
    """(papers, suggestions): the exact author's, else the best fuzzy one's; up to three suggestions."""
    plan = parse_author(query)
    exact = papers_of(index, plan.author)
    if not exact.isEmpty() or not plan.fuzzy or len(plan.author.encode()) < 3:
        return exact, []
    near = [r["author_key"] for r in fuzzy_authors(index, plan.author, plan.max_edits).limit(3).collect()]
    return (papers_of(index, near[0]), near) if near else (exact, [])


def by_title(index: Index, query: str) -> DataFrame:
    return index.documents.where(F.col("title_key") == " ".join(py_tokens(query)))


def by_title_terms(index: Index, query: str) -> DataFrame:
    """The same answer from postings: the rarest term's documents, verified by key."""
    terms = py_tokens(query)
    rare = index.lexicon.where(F.col("term").isin(terms)).orderBy("df", "term").limit(1)
    seeds = index.postings.join(F.broadcast(rare.select("term")), "term", "left_semi").select("doc_id")
    return index.documents.join(seeds, "doc_id", "left_semi").where(F.col("title_key") == " ".join(terms))


def collaborators(authors: DataFrame, key: str) -> DataFrame:
    """author_key, author_raw (first spelling), papers of everyone who shares a paper with the author."""
    own = authors.where(F.col("author_key") == key).select("doc_id").distinct()
    others = authors.join(own, "doc_id", "left_semi").where(F.col("author_key") != key)
    return others.groupBy("author_key").agg(F.min_by("author_raw", F.struct("doc_id", "pos")).alias("author_raw"), F.count_distinct("doc_id").alias("papers"))


def top_authors(authors: DataFrame, k: int = 100) -> DataFrame:
    """author_key, n: papers as listed, falling, names falling among equals."""
    return author_lexicon(authors).orderBy(F.desc("n"), F.desc("author_key")).limit(k)
