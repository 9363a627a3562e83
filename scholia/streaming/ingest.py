"""Incremental indexing: new record files append postings and yearly counts as they arrive.

Batches are written under their number, so a batch that runs again after a failure replaces itself, and
counts are partial sums that are added up when read. Nothing is kept in state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators import hot_words
from scholia.operators.index import normalise, term_frequencies


def index_stream(records: DataFrame, path: str, checkpoint: str, vocabulary: hot_words.Vocabulary | None = None) -> StreamingQuery:
    """records: a stream of doc_id, title, journal, year; a doc_id comes once."""

    def write(batch: DataFrame, number: int) -> None:
        d = normalise(batch)
        d.drop("tokens").write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
        term_frequencies(d).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        hot_words.year_terms(d, vocabulary).write.mode("overwrite").parquet(f"{path}/year_terms/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def yearly(spark: SparkSession, path: str) -> DataFrame:
    """year, term, freq over all batches."""
    return spark.read.parquet(f"{path}/year_terms").groupBy("year", "term").agg(F.sum("freq").alias("freq"))
