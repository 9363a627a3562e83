"""Latency summaries and saturating totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.graph import saturated


def latency_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, p50, p95, p99, max, mean; percentiles interpolate between neighbours."""
    quantiles = [F.percentile(value, p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.min(value).alias("min"), *quantiles, F.max(value).alias("max"), F.avg(value).alias("mean"))


def saturating_sum(c: Column) -> Column:
    return saturated(F.sum(c.cast("decimal(38,0)")))
