"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are dealt by hash to blocks of bounded size. Every block of queries meets every block of
candidates once, in a cell of its own: for each term the queries' weights times the term's postings are
added to dense score arrays; the best k of each query are selected by partition; a window over the
cells' k rows a query merges them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BLOCK, K = 512, 8192, 20
_TILE = 64


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores (queries, candidates) of integer vectors, exact: added term by term in the narrowest type that can't round."""
    terms = min(queries.shape[1], block.shape[1])
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(terms, 1)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
    if kind is object:
        whole = [[int(x) for x in v] for v in block[:, :terms]]
        return np.array([[sum(int(a) * b for a, b in zip(q[:terms], v, strict=True)) for v in whole] for q in queries], dtype=object).reshape(len(queries), len(block))
    postings = np.ascontiguousarray(block.T.astype(kind))
    weights = queries.astype(kind)
    scores = np.zeros((len(queries), len(block)), kind)
    scratch = np.empty((1, len(block)), kind)
    for q, row in zip(weights, scores, strict=True):
        for t in np.flatnonzero(q[:terms]):
            np.multiply(postings[t], q[t], out=scratch[0])
            row += scratch[0]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; ids rise."""
    if len(scores) <= k:
        return np.lexsort((ids, -scores))
    bar = np.partition(scores, len(scores) - k)[len(scores) - k]
    over, at = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
    chosen = np.concatenate([over, at[: k - len(over)]])
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def usable(vector: Column) -> Column:
    """Null vectors, and those with a null or non-finite component, take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine, F.lit(False))


def _matrix(column) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _cell(k: int, own_row: bool):
    import pandas as pd

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(block):
            block = block.sort_values(["known", "vec_id"], ascending=[False, True], kind="stable")
            ids, known, vectors = block["vec_id"].to_numpy(), block["known"].to_numpy(), _matrix(block["body"])
            asked = queries["vec_id"].to_numpy()
            q = _matrix(queries["v"])
            raw = list(block["body"])
            # candidates stand in the order of ties
            places = np.arange(len(ids))
            for a in range(0, len(q), _TILE):
                for at, scores in enumerate(accumulate(q[a : a + _TILE], vectors), a):
                    query, row = asked[at], queries["row"].iloc[at]
                    mine = known & (ids == query)
                    other = places if own_row else np.flatnonzero(~mine)
                    for j in other[best(scores[other], places[other], k + own_row)]:
                        same = bool(own_row and mine[j] and np.array_equal(raw[j], queries["v"].iloc[at]))
                        # the query's own score is never shown, so it may exceed a long
                        score = min(int(scores[j]), 2**63 - 1) if same else int(scores[j])
                        rows.append((query, row, ids[j] if known[j] else None, score, same))
        out = pd.DataFrame(rows, columns=["query_id", "row", "vec_id", "score", "same"])
        return out.assign(vec_id=pd.array([r[2] for r in rows], dtype="Int64"))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK, own_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k highest integer inner products with rows of vectors.

    Both tables have vec_id long and v array<double> of whole numbers; terms that one vector lacks count
    nothing. A row's own vec_id is no candidate, and rows without an id are left out. With own_row, queries
    are rows of vectors, and every row but the query's own is a candidate: others of its vec_id are, and so are
    rows without an id, after the others in ties. Ties go to the smaller vec_id. Repeated rows are queries and
    candidates each for itself. Fewer than k candidates: all.
    """
    queries = queries.where("vec_id is not null")
    vectors = vectors if own_row else vectors.where("vec_id is not null")
    n, m = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // query_block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # repeated rows would meet in one block: their position in the file deals them out as well
    # cogroup hashes each side's keys as they are, so g and b must have one type on both sides: an int and a long of one value part
    salt = F.pmod(F.xxhash64(F.col("vec_id"), F.col("v"), F.monotonically_increasing_id()), F.lit(1 << 40))
    left = queries.select("vec_id", "v", salt.alias("row")).select("*", (F.col("row") % groups).cast("int").alias("g"), each(blocks).alias("b"))
    held = vectors.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"), F.col("v").alias("body"), (salt % blocks).cast("int").alias("b"))
    right = held.select("*", each(groups).alias("g"))
    cells = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(_cell(k, own_row), "query_id long, row long, vec_id long, score long, same boolean")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = cells.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k + own_row)
    if own_row:
        # rows of one id and score are alike in the result, so the first copy of the query goes as its own row
        ranked = ranked.select("*", F.count_if("same").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("copies"))
        ranked = ranked.where(~(F.col("same") & (F.col("copies") == 1))).withColumn("rank", (F.col("rank") - F.least("copies", F.lit(1))).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, by: int = 64) -> DataFrame:
    """vec_id, v: each component x as floor(by * x)."""
    fine = vectors.where(usable(F.col("embedding")))
    return fine.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * by).cast("double")).alias("v"))


TOPK_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
k as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from k where rank <= 20
"""
