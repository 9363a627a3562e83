"""Lexical retrieval packing: windows filled with a seed document and its unused BM25 neighbours.

Rows are dealt by hash to shards of about SHARD_BYTES of text; the number of shards follows the corpus,
the size of one does not. Each shard has its own inverted index over token ids. A window starts with
what is left of a cut document or with the next unused one, and takes unused neighbours by BM25 score
until it is full; the last is cut and starts the next window, so only a shard's last one has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import tokens
from scholia.llm.common import BATCH_BYTES, bounded_batches, hand_back

WINDOW, END = 2048, 1
SHARD_BYTES, ROW_BYTES = 6_000_000, 100
K1, B = 1.2, 0.75
#: A term in more than one of so many documents of a shard has a dense row.
DENSE_SHARE = 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bm25Shard:
    """Postings of one shard: for each term, documents and their weights, as flat arrays; a term of many documents is a dense row too."""

    def __init__(self, docs: list[np.ndarray]):
        unique = [np.unique(d, return_counts=True) for d in docs]
        lengths = np.array([len(d) for d in docs], dtype=np.float32)
        sizes = np.array([len(t) for t, _ in unique], dtype=np.int64)
        term = np.concatenate([t for t, _ in unique]) if docs else np.zeros(0, np.uint32)
        tf = np.concatenate([n for _, n in unique]).astype(np.float32) if docs else np.zeros(0, np.float32)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        top = int(term.max()) + 1 if len(term) else 1
        df = np.bincount(term, minlength=top)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(float(lengths.mean()) if docs else 1.0, 1.0))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term.astype(np.uint16) if top <= 65536 else term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order].astype(np.float64)
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.n = len(docs)
        # rows are added as wholes; there are at most DENSE_SHARE times as many as a document has terms on the average
        self.row = np.full(top, -1)
        dense = np.flatnonzero(df * DENSE_SHARE > len(docs))
        self.row[dense] = np.arange(len(dense))
        self.rows = np.zeros((len(dense), len(docs)), np.float32)
        for t in dense:
            span = slice(self.at[t], self.at[t + 1])
            self.rows[self.row[t], self.post_doc[span]] = self.post_weight[span]
        bounds = np.cumsum(sizes)[:-1]
        self.dense_of = [x[x >= 0] for x in np.split(self.row[term], bounds)] if docs else []
        self.sparse_of = [t[x < 0] for t, x in zip(np.split(term, bounds), np.split(self.row[term], bounds), strict=True)] if docs else []

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for all terms of this one."""
        total = np.zeros(self.n)
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.sparse_of[doc]]
        if spans:
            total += np.bincount(np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), self.n)
        own = self.dense_of[doc]
        for a in range(0, len(own), 64):
            total += self.rows[own[a : a + 64]].sum(axis=0)
        return total

    def neighbours(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score, ties by position; all that share a query term."""
        s = self.scores(doc)
        s[~unused] = 0
        near = np.flatnonzero(s)
        if len(near) > 64:
            head = near[np.argpartition(-s[near], 31)[:32]]
            least = s[head].min()
            head = near[s[near] > least] if (s[near] == least).sum() + (s[near] > least).sum() > 32 else head
            head = head[np.lexsort((head, -s[head]))]
            yield from map(int, head)
            near = np.setdiff1d(near, head)
        yield from map(int, near[np.lexsort((near, -s[near]))])


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each id of each document is in exactly one."""
    index, unused, out = Bm25Shard(docs), np.ones(len(docs), dtype=bool), []
    queue, sequence, room, carry = 0, 0, window, None

    def place(doc: int, start: int) -> tuple[int, int] | None:
        """Puts what fits into the window; the rest, if any, closes it."""
        nonlocal sequence, room
        take = min(room, len(docs[doc]) - start)
        out.append((doc, start, take, sequence, window - room))
        room -= take
        if room == 0:
            sequence, room = sequence + 1, window
        return (doc, start + take) if start + take < len(docs[doc]) else None

    while True:
        if carry is None:
            while queue < len(docs) and not unused[queue]:
                queue += 1
            if queue == len(docs):
                return out
            unused[queue] = False
            carry = (queue, 0)
        seed = carry[0]
        while carry:
            carry = place(*carry)
        if room == window:
            continue
        for doc in index.neighbours(seed, unused):
            unused[doc] = False
            carry = place(doc, 0)
            if carry or room == window:
                break


def _pack_group(path: str, window: int, end: int):
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        enc, tail = tokens.encoder(path), np.array([end], "<u4")
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        shard, ids = group["shard"][0].as_py(), group["doc_id"].to_pylist()
        texts = group["text"].combine_chunks()
        del group
        docs = [np.concatenate([d, tail]) for d in enc.encode_all(texts)]
        del texts
        pieces = pack_shard(docs, window)
        cols = {
            "doc_id": pa.array([ids[d] for d, *_ in pieces], pa.int64()),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids": pa.array([docs[d][s : s + n].tobytes() for d, s, n, *_ in pieces], pa.binary()),
            "doc_tokens": pa.array([len(docs[d]) for d, *_ in pieces], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64()),
        }
        del docs
        hand_back()
        # in batches of bounded size, since the JVM holds each off its heap
        return pa.Table.from_batches(pa.table(cols).to_batches(max_chunksize=max(1, BATCH_BYTES // (4 * window + ROW_BYTES))))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its tokenizer ids and then `end`; null and empty texts are `end` alone. Repeated rows
    are packed each for itself, a null doc_id stays null, an empty table gives no pieces, other columns
    are not read. Sequences hold `window` ids but for the last one of a shard. The result depends on the
    rows alone: shards are hashes and are sorted before they are packed.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # a row weighs something even without a text, so that a shard's rows are bounded too
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    return dealt.groupBy("shard").applyInArrow(_pack_group(tokenizer, window, end), SCHEMA)
