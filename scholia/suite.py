"""Runs a query suite once, query by query, and summarises latencies."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scholia.operators.index import Index
from scholia.operators.search import Profile, search
from scholia.operators.stats import latency_summary
from scholia.sources.config import parse_suite, read_lines

#: The default suite: one query of each kind, over whatever words the caller's corpus has.
SHAPES = (
    ("q01", "single_term", "{0} page:1 size:20 fuzzy:off"),
    ("q02", "single_term", "{1} page:1 size:20 fuzzy:off"),
    ("q03", "multi_term_or", "{0} {1} {2} mode:or page:1 size:20 fuzzy:off"),
    ("q04", "multi_term_and", "{0} {1} {2} mode:and page:1 size:20 fuzzy:off"),
    ("q05", "phrase", '"{0} {1}" page:1 size:20 fuzzy:off'),
    ("q06", "prefix", "{3}* page:1 size:20 fuzzy:off"),
    ("q07", "fuzzy_typo", "{4} {0} page:1 size:20 fuzzy:1 fuzzyexp:4"),
    ("q08", "sort_newest", "{0} {1} sort:newest page:1 size:20 fuzzy:off"),
    ("q09", "deep_page", "{0} {1} page:3 size:20 fuzzy:off"),
)


@dataclass
class Result:
    id: str
    category: str
    query: str
    ok: bool
    total_ms: float
    rows: int
    profile: Profile


def run_suite(index: Index, suite: list[tuple[str, str, str]]) -> list[Result]:
    """Every query once, results counted but not shown; a query that fails is reported as not ok."""
    out = []
    for name, category, text in suite:
        start = time.perf_counter()
        try:
            page, profile = search(index, text)
            rows, ok = len(page.collect()), profile.path != "invalid_query"
        except Exception as e:  # noqa: BLE001  one broken query must not end the suite
            rows, ok, profile = 0, False, Profile(path="error", notes=[str(e)[:200]])
        took = (time.perf_counter() - start) * 1000
        profile.timers["total"] = took
        out.append(Result(name, category, text, ok, took, rows, profile))
    return out


def summary(spark: SparkSession, results: list[Result]) -> DataFrame:
    rows = [(r.total_ms,) for r in results]
    return latency_summary(spark.createDataFrame(rows, "ms double"), "ms")


def load_suite(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    return parse_suite(read_lines(spark, path))
