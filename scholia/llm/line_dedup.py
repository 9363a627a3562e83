"""Line deduplication: hashes range-partitioned with a secondary sort by document and position.

Only (hash, row, document, position) travels; the result is, per document, a compressed bitmap of its
lines. Two streaming ranks over each sorted hash, one down and one up the documents, tell at every row
whether it is the first occurrence and how many documents hold the line. Hashes with more than 1 in
1000 of all rows (so at most 1000 hashes: the one thing that is broadcast) skip the sort: partial
aggregates answer for them. Native: no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import SPACE, ascii_lower, scratch

HOT_SHARE = 1000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _row_key() -> list[Column]:
    """Rows with one doc_id and one text are the same row; others are told apart by their text."""
    return [F.col("doc_id"), F.xxhash64(_text()).alias("row")]


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, pos, h1, h2: the lines whose key is long enough; the hash has 128 bits."""
    lines = docs.select(*_row_key(), F.posexplode(F.split(_text(), "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("doc_id", "row", "pos", F.btrim(ascii_lower(F.col("line")), F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("second")).alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row, pos of every line to drop: its key is in min_docs documents or more, of which this is not the largest."""
    keys = scratch(line_keys(docs, min_chars).where(F.col("doc_id").isNotNull()), "lines")
    spark = docs.sparkSession
    total = keys.count()
    counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    hot = scratch(counts.where(F.col("n") > max(total // HOT_SHARE, 1000)).select("h1", "h2"), "hot")
    # ordinary hashes: sorted ranges; nothing of a hash is held in memory but its running ranks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = keys.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    down = Window.partitionBy("h1", "h2").orderBy(F.desc("doc_id"))
    up = Window.partitionBy("h1", "h2").orderBy("doc_id")
    ranks = ranged.select("*", F.dense_rank().over(down).alias("d")).select("*", F.dense_rank().over(up).alias("u"))
    cold = ranks.where((F.col("d") > 1) & (F.col("d") + F.col("u") - 1 >= min_docs))
    # hot hashes: one row a document, then the largest document and the number of them, both map-side first
    theirs = keys.join(F.broadcast(hot), ["h1", "h2"])
    facts = theirs.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.sum("one").alias("n")).where(F.col("n") >= min_docs)
    more = theirs.join(F.broadcast(facts), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    return cold.select("doc_id", "row", "pos").unionByName(more.select("doc_id", "row", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row, dropped: a compressed bitmap: (word, bits) for each 64 lines of which one goes; the other bits are kept lines.

    Only documents that lose a line have a row. A document without an id has no rank among the others: it
    keeps its lines and is not counted. Null and empty texts are one empty line. Repeated rows count once.
    """
    words = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "row", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """_row (all columns), _lines, _kept."""
    rows = docs.select(F.struct("*").alias("_row"), *_row_key()).select(F.col("_row"), F.col("doc_id").alias("_id"), F.col("row").alias("_hash"))
    joined = rows.join(bitmaps.select(F.col("doc_id").alias("_id"), F.col("row").alias("_hash"), F.map_from_entries("dropped").alias("_map")), ["_id", "_hash"], "left")
    lines = F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n", -1)
    kept = F.expr("filter(_lines, (line, i) -> (coalesce(_map[shiftright(i, 6)], 0L) & shiftleft(1L, i & 63)) = 0)")
    return joined.withColumn("_lines", lines).withColumn("_kept", F.when(F.col("_map").isNull(), F.col("_lines")).otherwise(kept))


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return _applied(docs.select("doc_id", "text"), bitmaps).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("_kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the dropped lines gone from text and, where it is there, n_chars set anew; no document goes."""
    out = _applied(docs, keep_bitmaps(docs, min_chars, min_docs))
    text = F.when(F.col("_map").isNull(), F.col("_row.text")).otherwise(F.array_join("_kept", "\n"))
    cols = [text.alias(c) if c == "text" else F.when(F.col("_map").isNull(), F.col("_row").getField(c)).otherwise(F.length(text).cast(t)).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c) for c, t in docs.dtypes]
    return out.select(*cols)


DIGEST_SQL = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from l),
k as (select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from e),
g as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.pos, k.line, (g.key is not null and k.doc_id <> g.keeper) as gone from k left join g on k.key = g.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from j group by doc_id
"""
