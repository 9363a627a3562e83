"""Text configuration: stopwords, aliases and query suites. Lines that start with # are comments."""

from __future__ import annotations

from pyspark.sql import SparkSession


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file on any store that Spark reads."""
    return [r["value"].rstrip("\r") for r in spark.read.text(path).collect()]


def parse_suite(lines: list[str]) -> list[tuple[str, str, str]]:
    """(id, category, query) of `id|category|query` lines; others are skipped."""
    out = []
    for line in lines:
        parts = [p.strip() for p in line.split("|", 2)]
        if line.strip() and not line.lstrip().startswith("#") and len(parts) == 3 and all(parts):
            out.append((parts[0], parts[1], parts[2]))
    return out
