"""The index: document facts, postings, lexicons and yearly terms as lazily built tables, and their Parquet form.

Nothing is computed until a query asks: filters on `term` reach below the aggregations, so a query over a
raw corpus shuffles its own terms only, and over a saved index reads only their row groups.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.text import norm_key, tokens, trigrams
from scholia.shared import cut, store_dir

FORMAT = 2
BLOCK = 128


def normalise(documents: DataFrame) -> DataFrame:
    """documents with tokens, doc_length and title_key; missing texts are empty, a missing year is 0."""
    d = documents.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("tokens", tokens(F.col("title")))
    return d.withColumns({"doc_length": F.size("tokens"), "title_key": F.array_join("tokens", " "), "year": F.coalesce("year", F.lit(0))})


def term_frequencies(documents: DataFrame) -> DataFrame:
    """term, doc_id, tf: one row for each term of each document."""
    return documents.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_authors(documents: DataFrame) -> DataFrame:
    """doc_id, pos, author_raw, author_key: a repeated author has repeated rows."""
    rows = documents.select("doc_id", F.posexplode("authors").alias("pos", "author_raw"))
    return rows.withColumn("author_key", norm_key(F.col("author_raw"))).where("author_key <> ''")


def author_lexicon(authors: DataFrame) -> DataFrame:
    """author_key, n: papers as listed, repetitions counted."""
    return authors.groupBy("author_key").agg(F.count("*").alias("n"))


def trigram_table(lexicon: DataFrame, key: str) -> DataFrame:
    return lexicon.select(F.explode(trigrams(F.col(key))).alias("gram"), key)


def block_max(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """term, block, end_doc, max_tf for every `size` postings of a term in doc_id order."""
    # a frequent term spans ranges: its postings are ranked within each and start after those of the ranges before
    placed = cut(postings.repartitionByRange("term", "doc_id").withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("term", "_part").agg(F.count("*").alias("n"))
    before = counts.select("term", "_part", (F.sum("n").over(Window.partitionBy("term").orderBy("_part")) - F.col("n")).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("term", "_part").orderBy("doc_id")) - 1)
    rank = F.col("_before") + F.col("_rank")
    return ranked.join(before, ["term", "_part"]).withColumn("block", F.floor(rank / size)).groupBy("term", "block").agg(F.max("doc_id").alias("end_doc"), F.max("tf").alias("max_tf"))


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    authors: DataFrame | None = None
    stored: bool = False
    facts: tuple[int, float] | None = None

    def corpus(self) -> tuple[int, float]:
        """(documents, average length), empty titles included; a stored index knows them."""
        if self.facts:
            return self.facts
        r = self.documents.agg(F.count("*").alias("n"), F.avg("doc_length").alias("a")).first()
        return r["n"], r["a"] or 0.0


def build_index(documents: DataFrame) -> Index:
    """Lazy: every member is a plan over documents."""
    d = normalise(documents)
    postings = term_frequencies(d)
    return Index(d, postings, document_frequencies(postings), doc_authors(documents) if "authors" in documents.columns else None)


def save_index(index: Index, path: str, fingerprint: str = "") -> None:
    """Tables sorted by what they are looked up by, then a manifest that marks them whole."""
    spark = index.documents.sparkSession
    index.documents.drop("tokens").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/documents")
    # a frequent term's postings may span files: ranges are cut by (term, doc_id)
    # and they carry what scores and their order need of a document, so that a search joins its page alone
    facts = index.documents.select("doc_id", "doc_length", "year", F.explode("tokens").alias("term"))
    postings = facts.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.first("doc_length").alias("doc_length"), F.first("year").alias("year"))
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    document_frequencies(stored).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
    if index.authors is not None:
        index.authors.repartitionByRange("author_key", "doc_id").sortWithinPartitions("author_key", "doc_id").write.mode("overwrite").parquet(f"{path}/authors")
    n, avg = index.corpus()
    manifest = json.dumps({"format": FORMAT, "source": fingerprint, "authors": index.authors is not None, "documents": n, "avg_length": avg})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, fingerprint: str | None = None) -> Index | None:
    """None where no whole index of this format, and of this source if one is named, is stored."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    except Exception as e:  # noqa: BLE001  Spark has one class for a missing path and others for broken files
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if manifest.get("format") != FORMAT or (fingerprint is not None and manifest.get("source") != fingerprint):
        return None
    d = spark.read.parquet(f"{path}/documents")
    authors = spark.read.parquet(f"{path}/authors") if manifest["authors"] else None
    return Index(d.withColumn("tokens", F.filter(F.split("title_key", " "), lambda t: t != "")), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lexicon"), authors, stored=True, facts=(manifest["documents"], manifest["avg_length"]))


_OPEN: dict[tuple[str, str], Index] = {}


def stored_index(spark: SparkSession, key: str, documents: Callable[[], DataFrame]) -> Index:
    """The index of the content `key`, built from documents() and saved where it is not stored yet."""
    path = f"{store_dir(spark)}/index/{key}"
    known = (spark.sparkContext.applicationId, path)
    if known not in _OPEN:
        found = load_index(spark, path, key)
        if found is None:
            save_index(build_index(documents()), path, key)
            found = load_index(spark, path, key)
        _OPEN[known] = found
    return _OPEN[known]
