"""Output: document details as text, and exports of any result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

_SHOWN = ("title", "authors", "journal", "year", "volume", "month", "cdrom", "ee", "url", "doc_length")
_ALWAYS = frozenset(("year", "doc_length"))


def details(doc: Row) -> str:
    """One `field: value` line each; empty fields are left out, year and token count never."""
    d, lines = doc.asDict(), []
    for name in _SHOWN:
        value = d.get(name)
        if isinstance(value, list):
            value = "| ".join(value)
        if value or (name in _ALWAYS and value is not None):
            lines.append(f"{name}: {value}")
    return "\n".join(lines)


def export(df: DataFrame, path: str, format: str = "json") -> None:
    """json, csv or parquet; arrays become '| '-joined strings in csv."""
    if format == "csv":
        from pyspark.sql import functions as F

        df = df.select(*[F.array_join(c, "| ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(df.write.mode("overwrite"), format)(path)
