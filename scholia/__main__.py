"""python -m scholia: build an index from a bibliography dump or load one, then answer a query or run a suite."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from scholia import suite
from scholia.functions.text import py_tokens
from scholia.operators import graph, hot_words, lookup, search
from scholia.operators.index import build_index, load_index, save_index
from scholia.sources.bibliography import read_bibliography
from scholia.sources.config import read_lines
from scholia.sources.sinks import details, export


def main(args: list[str]) -> int:
    ap = argparse.ArgumentParser(prog="scholia")
    ap.add_argument("xml", nargs="?", help="bibliography dump")
    ap.add_argument("--index", required=True, help="folder of the index")
    ap.add_argument("--rebuild", action="store_true")
    ap.add_argument("-b", "--benchmark", metavar="SUITE")
    ap.add_argument("--author")
    ap.add_argument("--title")
    ap.add_argument("--collaborators", metavar="AUTHOR")
    ap.add_argument("--top-authors", action="store_true")
    ap.add_argument("--hot-words", type=int, metavar="YEAR")
    ap.add_argument("--stopwords")
    ap.add_argument("--aliases")
    ap.add_argument("--search")
    ap.add_argument("--cliques", type=int, metavar="K")
    ap.add_argument("--author-cliques", metavar="AUTHOR")
    ap.add_argument("--export", metavar="PATH")
    a = ap.parse_args(args)
    spark = SparkSession.builder.appName("scholia").getOrCreate()
    start = time.perf_counter()
    index = None if a.rebuild else load_index(spark, a.index, a.xml)
    if index is None:
        if not a.xml:
            ap.error("no whole index there, and no dump to build it from")
        save_index(build_index(read_bibliography(spark, a.xml)), a.index, a.xml)
        index = load_index(spark, a.index, a.xml)
    print(f"ready in {time.perf_counter() - start:.1f} s")
    if a.benchmark:
        results = suite.run_suite(index, suite.load_suite(spark, a.benchmark))
        for r in results:
            print(r.id, r.category, "ok" if r.ok else "FAILED", f"{r.total_ms:.1f} ms", r.profile.as_row())
        suite.summary(spark, results).show(truncate=False)
    out = None
    if a.author:
        out, near = lookup.by_author(index, a.author)
        print(*(f"did you mean {n}?" for n in near), sep="\n")
    elif a.title:
        out = lookup.by_title(index, a.title)
    elif a.collaborators:
        out = lookup.collaborators(index.authors, " ".join(py_tokens(a.collaborators)))
    elif a.top_authors:
        out = lookup.top_authors(index.authors)
    elif a.hot_words is not None:
        words = hot_words.Vocabulary()
        words = words.with_stopwords(read_lines(spark, a.stopwords)) if a.stopwords else words
        words = words.with_aliases(read_lines(spark, a.aliases)) if a.aliases else words
        out = hot_words.hot_words(index.documents, a.hot_words, vocabulary=words)
    elif a.search:
        out, profile = search.search(index, a.search)
        print(profile.as_row(), *profile.notes)
    elif a.cliques:
        out = graph.clique_counts(graph.edges(index.authors), a.cliques)
    elif a.author_cliques:
        out = graph.maximal_clique_sizes(index.authors, " ".join(py_tokens(a.author_cliques)))
    if out is not None and a.export:
        export(out, a.export)
    elif out is not None and (a.author or a.title):
        print(*(details(r) for r in out.limit(100).collect()), sep="\n\n")
    elif out is not None:
        out.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
