"""Adapters: the driver's tables as bibliographic records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: text as title, source as journal, a year from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("title"), F.col("source").alias("journal"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as papers: names of the ordered parts as title, the year of the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = lines.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("x"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("journal"))
    joined = orders.join(named, F.col("doc_id") == F.col("l_orderkey"), "left")
    return joined.select("doc_id", F.coalesce(F.array_join(F.col("x.p_name"), " "), F.lit("")).alias("title"), "journal", "year")


def supplier_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_authors: the supplier of each line as an author of its order."""
    from scholia.functions.text import norm_key

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author_raw"))
    return lines.join(names, "l_suppkey").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), "author_raw", norm_key(F.col("author_raw")).alias("author_key"))


def part_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_authors: the part of each line as an author of its order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("author_key"))
