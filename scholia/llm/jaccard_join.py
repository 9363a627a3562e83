"""Size-aware heavy-light Jaccard join on word shingles, and its connected components.

Equal sets are one node from the start. Elements are ordered rare first by a fixed-size count sketch of
the whole corpus (any order is right; this one keeps lists short). Of two sets that link, the first
`n - ceil(t * n) + k` elements share k: light sets enumerate the 2-subsets of that prefix, heavy ones
stand in the inverted list of each of its elements, and the size at which light ends is the one of least
cost over the corpus's size histogram. Sets just below it do both, and so do sets so small that one
shared element may suffice, so no pair is missed.

A list never becomes pairs of all its members. First each member meets its list's least one; the links
found are contracted, lists within one component are done, and only members of different components of
one list meet, in blocks, which the size and position bounds still allow, and whose parity sketches do: the
bits in which two sketches differ are at most the elements in which the sets do, so a pair that differs in
more bits than links may is no link, and it becomes no row. Every link is verified on whole sets, those of
a set that stands in many pairs in several tasks. That gives the components. link_counts() gives the join's links themselves, within components too: all
different sets of a list that the bounds allow meet, in blocks, and are verified.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import bounded_batches, forget, scratch
from scholia.llm.components import components
from scholia.llm.shingles import mix, shingle_sets

SKETCH_BITS, SLICES = 24, 64
#: Ids of documents whose sets are fetched are broadcast up to this many, and joined beyond.
FEW_IDS = 1_000_000
#: Copies (set and id) that are broadcast.
FEW_COPIES = 300_000
#: Sets of one list in a block of the join of all pairs, and pairs of one set that are verified in one task.
BLOCK = 1000
#: Up to so many members a list's pairs are few; beyond, parity sketches of so many 64-bit words (a power of two) go before them.
SHORT, PARITY = 64, 16
_SIZES = 4096
#: What a list entry is counted to meet at most: a member meets its list's head, however long the list.
MET = 2.0
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def required(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any set that links to it."""
    return -(-num * n // den)


def _sketch(n_words: int):
    """Of a partition: for each slice of the hash space the counts of its buckets; as slice -1 the histogram of set sizes."""
    bits, width = SKETCH_BITS, 1 << (SKETCH_BITS - SLICES.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(1 << bits, np.uint16), np.zeros(_SIZES + 64, np.int64)
        held, n_held = [], 0

        def flush() -> None:
            nonlocal n_held
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)
                held.clear()
                n_held = 0

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), n_words):
                held.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                n_held += len(s)
                sizes[len(s) if len(s) < _SIZES else _SIZES + len(s).bit_length()] += 1
                if n_held >= 1 << 20:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"slice": pa.array([-1], pa.int32()), "body": pa.array([zlib.compress(sizes.tobytes(), 1)], pa.binary())})
        for k in range(SLICES):
            part = counts[k * width : (k + 1) * width]
            at = np.flatnonzero(part).astype(np.uint32)
            if len(at) * 3 < width:
                body = b"s" + zlib.compress(at.tobytes() + part[at].tobytes(), 1)
            else:
                body = b"d" + zlib.compress(part.tobytes(), 1)
            if len(at):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "body": pa.array([body], pa.binary())})

    return run


def _sum_sketches():
    """Of the slices dealt to a task, one at a time in any order: classes of the summed counts, four to each doubling."""
    width = 1 << (SKETCH_BITS - SLICES.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k < 0:
                    got = np.frombuffer(zlib.decompress(body), np.int64)
                    sums[k] = sums.get(k, 0) + got
                    continue
                total = sums.setdefault(k, np.zeros(width, np.int64))
                raw = zlib.decompress(body[1:])
                if body[:1] == b"s":
                    n = len(raw) // 6
                    total[np.frombuffer(raw, np.uint32, n)] += np.frombuffer(raw, np.uint16, n, 4 * n)
                else:
                    total += np.frombuffer(raw, np.uint16)
        for k, total in sums.items():
            body = total if k < 0 else np.minimum(4 * np.log2(total + 1.0), 255).astype(np.uint8)
            some = 0 if k < 0 else int((total > 0).sum())
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "n": pa.array([0 if k < 0 else int(total.sum())], pa.int64()), "some": pa.array([some], pa.int64()), "body": pa.array([zlib.compress(body.tobytes(), 1)], pa.binary())})

    return run


def light_limit(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """The largest set size handled by 2-subsets, at least cost: subsets enumerated against list entries and what scanning them meets."""
    order, best, at = sorted(sizes), None, 0
    for limit in [0, *(n for n in order if n <= 512)]:
        light = sum(c * comb(max(n - required(n, num, den) + 2, 0), 2) for n, c in sizes.items() if n <= limit)
        heavy = sum(c * (n - required(n, num, den) + 1) * (1 + list_length) for n, c in sizes.items() if n * den >= num * (limit + 1))
        if best is None or light + heavy < best:
            best, at = light + heavy, limit
    return at


def _entries(classes, n_words: int, num: int, den: int, limit: int):
    """For each document: size and fingerprint of its set, and its keys with their position in the order (-1: a 2-subset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(zlib.decompress(classes.value), np.uint8)
        shift = np.uint64(64 - SKETCH_BITS)
        # the largest set that may link by sharing one element alone, and what may link to it: 2-subsets don't find them
        single = den // num * den // num
        for batch in batches:
            ids, sizes, prints, keys, places, ends = [], [], [], [], [], [0]
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), n_words), strict=True):
                n, got, at = len(s), [], []
                if n:
                    need = required(n, num, den)
                    first = s[np.argsort(rank[(s >> shift).astype(np.int64)], kind="stable")[: n - need + 2]]
                    if n <= limit and need >= 2:
                        i, j = np.triu_indices(len(first), 1)
                        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                        got.append(mix(low * _PAIR + high))
                        at.append(np.full(len(i), -1, np.int32))
                    if n * den >= num * (limit + 1) or n <= single:
                        got.append(first[: n - need + 1])
                        at.append(np.arange(n - need + 1, dtype=np.int32))
                ids.append(doc)
                sizes.append(n)
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                keys += got
                places += at
                ends.append(ends[-1] + sum(map(len, got)))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            flat_at = np.concatenate(places) if places else np.zeros(0, np.int32)
            ends = pa.array(ends, pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(flat, pa.int64()), pa.array(flat_at, pa.int32())], ["key", "pos"])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "fp": pa.array(prints, pa.binary()), "keys": pa.ListArray.from_arrays(ends, pairs)})

    return run


def parity(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: each element flips one bit, so of two sketches those bits differ that an odd number of the differing elements flip."""
    bits = np.bincount((s * _PAIR >> np.uint64(64 - 6 - PARITY.bit_length() + 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sketched_sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1).to_pylist(), n_words))
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            bits = [parity(s).tolist() for s in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "fp": pa.array(prints, pa.binary()), "parity": pa.array(bits, pa.list_(pa.int64()))})

    return run


def _near(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets whose parity sketches differ so little can still link: |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|) for every link."""
    differ = " + ".join(f"bit_count({x}.parity[{k}] ^ {y}.parity[{k}])" for k in range(PARITY))
    return F.expr(f"coalesce(({differ}) * {den + num} <= {den - num} * ({x}.n + {y}.n), true)")


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n_words)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "body": pa.array(found, pa.binary())})

    return run


def _printed_sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n_words)]
            prints = [hashlib.blake2b(b, digest_size=16).digest() if b else None for b in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "fp": pa.array(prints, pa.binary()), "body": pa.array(found, pa.binary())})

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, None
            for k in range(batch.num_rows):
                body = batch.column(2)[k].as_buffer()
                if last is None or not body.equals(last):
                    last, x = body, np.frombuffer(body, np.uint64)
                y = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if not len(small) or den * len(small) < num * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).take(at), "b": batch.column(1).take(at)})

    return run


def _allowed(na: Column, pa_: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes that first meet at these positions can still link: exact for the first shared key, true for 2-subsets."""
    sized = (F.least(na, nb) * den >= F.greatest(na, nb) * num)
    left = F.least(na - pa_, nb - pb)
    return sized & ((pa_ < 0) | (pb < 0) | (left * (den + num) >= (na + nb) * num))


class JaccardJoin:
    """One run over a table of documents; nodes are document ids."""

    def __init__(self, docs: DataFrame, n_words: int = 5, num: int = 4, den: int = 5):
        self.docs, self.n_words, self.num, self.den = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n_words, num, den
        self.spark = docs.sparkSession
        bounded_batches(self.spark)

    def _order(self) -> tuple[bytes, int]:
        """The sketch's classes, a table of fixed size, and the light limit."""
        parts = self.docs.select("text").mapInArrow(_sketch(self.n_words), "slice int, body binary")
        rows = parts.repartition(SLICES // 4, "slice").mapInArrow(_sum_sketches(), "slice int, n long, some long, body binary").collect()
        width = 1 << (SKETCH_BITS - SLICES.bit_length() + 1)
        classes, sizes, n, some = np.zeros(1 << SKETCH_BITS, np.uint8), {}, 0, 0
        for r in rows:
            if r["slice"] < 0:
                got = np.frombuffer(zlib.decompress(r["body"]), np.int64)
                sizes = {(k if k < _SIZES else 1 << (k - _SIZES)): int(c) for k, c in enumerate(got) if c and k}
            else:
                classes[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(r["body"]), np.uint8)
                n, some = n + r["n"], some + r["some"]
        # in a sketch much fuller than its buckets, and where texts have many copies, the mean of a bucket is no list's length
        return zlib.compress(classes.tobytes(), 1), light_limit(sizes, min(n / max(some, 1), MET), self.num, self.den)

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets link, compared whole."""
        pairs = scratch(pairs, "pairs")
        ids = scratch(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
        sets = scratch(self.docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(self.n_words), "doc_id long, body binary"), "sets")
        links = scratch(self._compared(pairs, sets.withColumnRenamed("doc_id", "of")).mapInArrow(_verify(self.num, self.den), "a long, b long"), "links")
        forget(pairs, ids, sets)
        return links

    def _compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, x, y: the pairs with their sets (of, body). One set of each pair, a, may stand in very many of them: it is dealt over as many keys as these are blocks."""
        many = scratch(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("deals")), "many")
        n = many.count()
        if not n:
            one = pairs.join(sets.withColumnRenamed("of", "b").withColumnRenamed("body", "y"), "b")
            return one.join(sets.withColumnRenamed("of", "a").withColumnRenamed("body", "x"), "a").select("a", "b", "x", "y")
        many = F.broadcast(many) if n <= FEW_IDS else many
        dealt = pairs.join(many, "a", "left").withColumn("deal", F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("deals"))).cast("int")).drop("deals")
        one = dealt.join(sets.withColumnRenamed("of", "b").withColumnRenamed("body", "y"), "b")
        held = sets.withColumnRenamed("of", "a").withColumnRenamed("body", "x").join(many, "a", "left")
        held = held.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
        return one.join(held, ["a", "deal"]).select("a", "b", "x", "y")

    def _entries(self) -> DataFrame:
        classes, limit = self._order()
        sent = self.spark.sparkContext.broadcast(classes)
        schema = "doc_id long, n long, fp binary, keys array<struct<key:long,pos:int>>"
        return scratch(self.docs.mapInArrow(_entries(sent, self.n_words, self.num, self.den, limit), schema), "entries")

    def _with_parity(self, rest: DataFrame) -> DataFrame:
        """rest with the parity sketch of each node's set; null where an id stands on several sets."""
        ids = scratch(rest.select(F.col("node").alias("doc_id")).distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
        bits = self.docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sketched_sets(self.n_words), "doc_id long, fp binary, parity array<long>")
        one = bits.where("fp is not null").groupBy(F.col("doc_id").alias("node")).agg(F.min("fp").alias("f0"), F.max("fp").alias("f1"), F.min("parity").alias("parity")).where("f0 = f1").select("node", "parity")
        return rest.join(scratch(one, "parity"), "node", "left")

    def all_links(self) -> tuple[DataFrame, DataFrame]:
        """(entries, links): links has every pair of different sets that link, a < b by their fingerprints. It grows with the square of a group."""
        num, den = self.num, self.den
        entries = self._entries()
        known = entries.where("n > 0 and doc_id is not null")
        heads = scratch(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "heads")
        sets = known.join(heads, ["fp", "doc_id"], "left_semi")
        postings = scratch(sets.select("fp", "n", F.explode("keys").alias("k")).select("fp", "n", "k.key", "k.pos").distinct(), "postings")
        lists = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
        shared = scratch(postings.join(lists, "key"), "shared")
        # a block of a list meets the whole list, so a long one is dealt over as many keys as it has blocks
        x = shared.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).alias("x")
        y = shared.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.fp") < F.col("y.fp"))
        met = x.join(y, meet & _allowed(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den))
        pairs = scratch(met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct(), "pairs")
        wanted = scratch(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct().join(heads, "fp"), "wanted")
        bodies = self.docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_printed_sets(self.n_words), "doc_id long, fp binary, body binary")
        # one row a set: its head's id may be repeated, or stand on other sets too
        bodies = scratch(bodies.join(wanted, ["doc_id", "fp"], "left_semi").dropDuplicates(["fp"]).select("fp", "body"), "sets")
        return entries, scratch(self._compared(pairs, bodies.withColumnRenamed("fp", "of")).mapInArrow(_verify(num, den), "a binary, b binary"), "links")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(members, links): members has doc_id, n, node, component for each row of docs; links verified pairs of nodes that join all that link."""
        num, den = self.num, self.den
        entries = self._entries()
        known = entries.where("n > 0 and doc_id is not null")
        # copies fold map-side into one head; its keys are found by head and set, so no group of copies meets in a task
        heads = scratch(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "heads")
        homes = scratch(known.select("doc_id", "fp").join(heads, "fp"), "homes")
        copies = scratch(homes.where("doc_id <> node").select("fp", F.col("doc_id").alias("node")).distinct(), "copies")
        nodes = known.withColumnRenamed("doc_id", "node")
        # entries are moved to their heads only where the copies are too many to be sent round
        few = copies.count() <= FEW_COPIES
        nodes = nodes.join(F.broadcast(copies), ["fp", "node"], "left_anti") if few else nodes.join(heads, ["fp", "node"], "left_semi")
        postings = nodes.select("node", "n", F.explode("keys").alias("k")).select("node", "n", "k.key", "k.pos")
        # most keys are one set's alone: they are counted by themselves, and heads are sought in the lists that remain
        lists = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").drop("members")
        listed = scratch(postings.join(lists.hint("shuffle_hash"), "key"), "listed")
        # the keys, most of what was made so far, are not read again
        sizes = scratch(entries.select("doc_id", "n", "fp"), "sizes")
        forget(entries)
        led = listed.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("head"))
        shared = scratch(listed.join(led.hint("shuffle_hash"), "key"), "shared")
        forget(listed)
        # every member meets the head of its list
        h = F.col("head")
        stars = shared.where((F.col("node") != h["node"]) & _allowed(F.col("n"), F.col("pos"), h["n"], h["pos"], num, den))
        stars = scratch(stars.select(h["node"].alias("a"), F.col("node").alias("b")).distinct(), "stars")
        first = self._links(stars)
        # an id that stands on several texts ties them
        several = homes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
        first = scratch(first.unionByName(several), "links")
        # lists that still span components: members of different ones meet
        labels = components(first).select(F.col("node"), F.col("component").alias("comp"))
        placed = shared.drop("head").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members")).where("c0 <> c1").select("key", "members")
        rest = scratch(placed.join(open_, "key"), "rest")
        forget(shared)

        def apart(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
            allowed = _allowed(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
            met = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & more & (F.col("x.comp") < F.col("y.comp")) & allowed)
            return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

        short = rest.where(F.col("members") <= SHORT).select("key", "node", "n", "pos", "comp")
        met = apart(short, short, F.lit(True))
        long = rest.where(F.col("members") > SHORT)
        if not long.isEmpty():
            sketched = scratch(self._with_parity(long).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "sketched")
            # a block of a list meets the whole list, so a long one is dealt over as many keys as it has blocks
            x = sketched.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            y = sketched.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            met = met.unionByName(apart(x, y, (F.col("x.block") == F.col("y.block")) & _near("x", "y", num, den)))
        met = met.distinct()
        second = self._links(met.join(stars, ["a", "b"], "left_anti"))
        links = scratch(first.unionByName(second), "links")
        labels = scratch(components(links), "components")
        members = sizes.join(homes.distinct(), ["doc_id", "fp"], "left").join(labels, "node", "left")
        return members.select("doc_id", "n", "node", F.coalesce("component", "node", "doc_id").alias("component")), links


def similar_groups(docs: DataFrame, n_words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the smallest doc_id reachable by links of Jaccard >= num/den.

    Null and empty texts and texts without words have no shingles and link with nothing. A doc_id is one
    node: rows that repeat it share a component. A row without doc_id links with nothing and has a null
    component. Other columns are not read; an empty table gives an empty result.
    """
    members, _ = JaccardJoin(docs, n_words, num, den).run()
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def link_counts(docs: DataFrame, n_words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, n_links for each row of docs: with how many other documents it links by Jaccard >= num/den.

    Copies count, each for itself, but are not paired: a set stands for all that have it. A doc_id is one
    document, whatever its rows; texts without words and rows without doc_id link with nothing.
    """
    entries, links = JaccardJoin(docs, n_words, num, den).all_links()
    homes = scratch(entries.where("n > 0 and doc_id is not null").select("doc_id", "fp").distinct(), "homes")
    several = scratch(homes.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id"), "several")
    held = homes.groupBy("fp").agg(F.count("*").alias("docs"))
    # what a set links with, itself and its copies first
    near = links.select(F.col("a").alias("of"), F.col("b").alias("fp")).unionByName(links.select(F.col("b").alias("of"), F.col("a").alias("fp")))
    near = scratch(near.unionByName(held.select(F.col("fp").alias("of"), "fp")), "near")
    tied = scratch(homes.join(several, "doc_id", "left_semi").withColumnRenamed("doc_id", "tied"), "tied")

    def others(near: DataFrame, of: str) -> DataFrame:
        """Documents on the sets near each `of` but itself; one that stands on several of them counts once."""
        twice = near.join(tied, "fp").groupBy(of, "tied").agg((1 - F.count("*")).alias("docs")).select(of, "docs")
        return near.join(held, "fp").select(of, "docs").unionByName(twice).groupBy(of).agg((F.sum("docs") - 1).alias("n_links"))

    single = homes.join(several, "doc_id", "left_anti").join(others(near, "of").withColumnRenamed("of", "fp"), "fp").select("doc_id", "n_links")
    mine = tied.withColumnRenamed("tied", "doc_id").withColumnRenamed("fp", "of").join(near, "of").select("doc_id", "fp").distinct()
    counts = scratch(single.unionByName(others(scratch(mine, "mine"), "doc_id")), "counts")
    return entries.select("doc_id", F.col("n").alias("n_shingles")).join(counts, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id; rows without an id stay.

    Rows that repeat an id are one document: of those with equal texts the least by its other columns
    stays, and all its different texts do. Only such rows are shuffled with their texts.
    """
    groups = similar_groups(docs, **how).where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(scratch(groups, "gone"), "doc_id", "left_anti").select(*docs.columns)
    repeated = scratch(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    single = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    several = left.join(repeated, "doc_id", "left_semi").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_text"), F.struct(*docs.columns).alias("_row"))
    least = several.groupBy("doc_id", "_text", F.col("_row.text").isNull()).agg(F.min("_row").alias("_row"))
    return single.unionByName(least.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))


GROUPS_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w),
n as (select doc_id, len(sh) as n from s),
e as materialized (select doc_id, unnest(sh) as g from s),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as materialized (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from s union select r.a, u.b from r join u on r.b = u.a)
select s.doc_id, len(sh)::bigint as n_shingles, m.component_id from s join (select a as doc_id, min(b) as component_id from r group by a) m on s.doc_id = m.doc_id
"""
