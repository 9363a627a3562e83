"""Masked pseudo-likelihood of documents.

Words (A-Z folded) are counted over the whole corpus; the most frequent (VOCABULARY, and more as the corpus
grows) are tokens of their own, the others fall by hash into RARE buckets. A window network sees the two
tokens on either side of a position and predicts the token in the middle: its hidden state decides at every
inner node of a binary tree over all tokens (frequent ones near the root) which way to go, so that
p(token | window) is the product of the decisions on the token's path, learned node by node, and sums to
one over all tokens without being computed for all of them. A rare word's probability is its bucket's times
its share of the bucket, from the counts of all words.

Texts are encoded once. Training is data-parallel: each partition takes gradient steps on every position of
its documents from the same start; then each parameter's values are averaged by how often the partitions
trained it, in a tree of bounded fan-in, and only what was trained is sent. Scoring sums the log-probability
of every token of every text.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import one_thread, scratch

VOCABULARY, RARE = 4096, 64
WIDTH, HIDDEN, REACH = 16, 16, 2
ROUNDS, BATCH, RATE = 1, 2048, 0.1
#: Products with the nodes nearest the root, by how often they are passed, are one matrix product for all positions.
DENSE = 64
#: Parameters of so many partitions are averaged by one step of the tree.
FAN_IN = 32
_PIECE, _COUNTED = 1 << 19, 300_000
_BLOCK, _ROWS = 1 << 14, 1 << 10
#: Positions scored at once: few enough that a core's cache holds what they take.
_AT_ONCE = 1 << 12


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, a bounded piece at a time."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        stop = at + _PIECE
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield data[at:stop].lower().split()
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return got

    for batch in batches:
        for t in batch.column(0).to_pylist():
            for part in words(t):
                held.update(part)
                if len(held) > _COUNTED:
                    yield out()
    yield out()


class Ids(dict):
    """Ids of words that are tokens of their own; any other word's is its bucket's."""

    def __missing__(self, word: bytes) -> int:
        return VOCABULARY + zlib.crc32(word) % RARE


PAD = VOCABULARY + RARE


def huffman(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens with counts n: the node above each token and node, whether it is that node's second child, and the nodes' counts; the root is last."""
    k, heap = len(n), [(float(c), i) for i, c in enumerate(n)]
    heapq.heapify(heap)
    above, second, mass = np.zeros(2 * k - 1, np.int64), np.zeros(2 * k - 1, bool), np.concatenate([n, np.zeros(k - 1)])
    for node in range(k, 2 * k - 1):
        (ca, a), (cb, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = node
        second[b], mass[node] = True, ca + cb
        heapq.heappush(heap, (ca + cb, node))
    return above, second, mass[k:]


class Vocabulary:
    """Words by rank and the tree over all ids, from corpus counts.

    Ids: the first VOCABULARY words, the buckets, PAD, and then the words beyond VOCABULARY. Nodes are
    numbered by falling count, so the DENSE first ones are those that most positions pass. `at`, `nodes` and
    `turns` hold each id's path: nodes[at[i] : at[i + 1]], and 1 where it goes to the second child.
    """

    def __init__(self, counted: list[tuple[bytes, int]], total: int, rare: dict[int, int] | None = None):
        """rare: of each bucket how many tokens of the corpus are in it; else what the listed words leave is spread over all."""
        self.words = [w for w, _ in counted]
        at = np.arange(len(counted))
        self.ids = at + (at >= VOCABULARY) * (RARE + 1)
        n = np.zeros(PAD + 1 + max(len(counted) - VOCABULARY, 0))
        n[self.ids] = [c for _, c in counted]
        if rare is None:
            n[VOCABULARY:PAD] = max(total - n.sum(), 0) / RARE
        else:
            n[VOCABULARY:PAD] = [rare.get(k, 0) for k in range(RARE)]
        #: Log of the tokens of each bucket; a rare word's share of it is its own count over this.
        self.log_rare = np.log(np.maximum(n[VOCABULARY:PAD], 1))
        n += 0.5  # every id keeps a little
        # ids that no word has (of a small vocabulary) and PAD are in no text and not in the tree
        known = np.concatenate([self.ids, np.arange(VOCABULARY, PAD)])
        above, second, mass = huffman(n[known])
        k, root = len(known), 2 * len(known) - 2
        order = np.argsort(-mass, kind="stable")
        number = np.empty(k - 1, np.int32)
        number[order] = np.arange(k - 1)
        self.size, self.count = len(n), k - 1
        half = np.zeros(k - 1)
        half[above[:-1][second[:-1]] - k] = np.concatenate([n[known], mass])[:-1][second[:-1]]
        p = half[order] / mass[order]
        #: Log-odds of each node's second child: the network starts as the unigram model.
        self.prior = np.log(p / (1 - p)).astype(np.float32)
        # paths level by level, from the tokens up
        now, owner, levels = np.arange(k), known, []
        while len(now):
            up = now != root
            now, owner = now[up], owner[up]
            levels.append((owner, number[above[now] - k], second[now]))
            now = above[now]
        owners, nodes, turns = (np.concatenate(x) for x in zip(*levels, strict=True))
        order = np.lexsort((nodes, owners))
        self.nodes, self.turns = nodes[order].astype(np.int32), turns[order].astype(np.float32)
        self.at = np.searchsorted(owners[order], np.arange(self.size + 1))
        # paths in two parts: through the dense nodes, and beyond
        dense, owner = self.nodes < DENSE, owners[order]
        self.top_nodes, self.top_turns = self.nodes[dense], self.turns[dense]
        self.rest_nodes, self.rest_turns = self.nodes[~dense], self.turns[~dense]
        self.top_at, self.rest_at = (np.searchsorted(owner[x], np.arange(self.size + 1)) for x in (dense, ~dense))

    def lookup(self) -> Ids:
        return Ids(zip(self.words, self.ids.tolist(), strict=True))


def _spans(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at[i]..at[i + 1] of all ids, one after the other, and how many each has."""
    n = at[ids + 1] - at[ids]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[ids] - ends + n, n), n


def initial(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """embed: a row for each id; in: the hidden layer, a block of columns for each side position; b; node: a row for each node of the tree, the bias last."""
    rng = np.random.default_rng(seed)
    embed = (0.5 * rng.standard_normal((vocabulary.size, WIDTH))).astype(np.float32)
    inward = (rng.standard_normal((WIDTH, 2 * REACH * HIDDEN)) / np.sqrt(2 * REACH * WIDTH)).astype(np.float32)
    node = (0.1 * rng.standard_normal((max(vocabulary.count, DENSE), HIDDEN + 1))).astype(np.float32)
    node[:, HIDDEN] = 0
    node[: vocabulary.count, HIDDEN] = vocabulary.prior
    return {"embed": embed, "in": inward, "b": np.zeros(HIDDEN, np.float32), "node": node}


#: Where the tokens on either side stand in a run that begins REACH before its first position.
_SIDES = tuple(k + REACH for k in (*range(-REACH, 0), *range(1, REACH + 1)))


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(2 * REACH)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    z *= 0.5
    np.tanh(z, out=z)
    z += 1
    z *= 0.5
    return z


def _sums(at: np.ndarray, values: np.ndarray, n: int, scale: np.ndarray | None = None) -> np.ndarray:
    """(n, columns): sums of the values' rows, each times its scale, by their numbers below n."""
    out = np.empty((n, values.shape[1]), values.dtype)
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(at, values[:, k] if scale is None else values[:, k] * scale, n)
    return out


def _by_row(rows: np.ndarray, values: np.ndarray, n: int, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of n, the sums of their values, each times its scale, and how often each came."""
    present = np.zeros(n, bool)
    present[rows] = True
    some = np.flatnonzero(present)
    place = np.empty(n, np.int64)
    place[some] = np.arange(len(some))
    at = place[rows]
    return some, _sums(at, values, len(some), scale), np.bincount(at, minlength=len(some))


def gradients(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray) -> dict[str, tuple]:
    """Of the mean -log p(token | window) over a run of ids but for its first and last REACH: for each parameter (rows, gradients, times); rows None: of the whole array.

    Neighbours share their windows, so each token's row is fetched and changed once for the run, not once for each window.
    """
    n = len(ids) - 2 * REACH
    asked = np.flatnonzero(ids[REACH : n + REACH] != PAD)
    target, e = ids[asked + REACH], p["embed"].take(ids, axis=0)
    shown = e @ p["in"]
    h = p["b"] + sum(x[k : k + n] for k, x in zip(_SIDES, _blocks(shown), strict=True))
    h = np.tanh(h).take(asked, axis=0)
    top, bias = p["node"][:DENSE, :HIDDEN], p["node"][:, HIDDEN]
    # the nodes near the root: all products at once, of which paths take theirs
    at, count = _spans(vocabulary.top_at, target)
    nodes = vocabulary.top_nodes[at]
    cell = np.repeat(np.arange(0, DENSE * len(target), DENSE), count) + nodes
    d = _sigmoid((h @ top.T).ravel().take(cell) + bias.take(nodes))
    d -= vocabulary.top_turns[at]
    d /= len(target)
    g = np.zeros((len(target), DENSE), h.dtype)
    g.ravel()[cell] = d
    dh = g @ top
    times = np.bincount(nodes, minlength=DENSE)
    out = {"node": (np.arange(DENSE), np.concatenate([g.T @ h, g.sum(0)[:, None]], axis=1), times)}
    # the others, one by one
    at, count = _spans(vocabulary.rest_at, target)
    if len(at):
        nodes = vocabulary.rest_nodes[at]
        v = p["node"].take(nodes, axis=0)
        hidden = np.empty_like(v)
        hidden[:, :HIDDEN] = np.repeat(h, count, axis=0)
        hidden[:, HIDDEN] = 1
        d = _sigmoid(np.einsum("ij,ij->i", hidden, v))
        d -= vocabulary.rest_turns[at]
        d /= len(target)
        dh += _sums(np.repeat(np.arange(len(target)), count), v[:, :HIDDEN], len(target), d)
        out["node"] = tuple(np.concatenate(x) for x in zip(out["node"], _by_row(nodes, hidden, len(p["node"]), d), strict=True))
    dh *= 1 - h * h
    whole = np.zeros((n, HIDDEN), h.dtype)
    whole[asked] = dh
    de = np.zeros_like(e)
    for k, w in zip(_SIDES, _blocks(p["in"]), strict=True):
        de[k : k + n] += whole @ w.T
    out["embed"] = _by_row(ids, de, len(p["embed"]))
    return out | {"in": (None, np.concatenate([e[k : k + n].T @ whole for k in _SIDES], axis=1), n), "b": (None, dh.sum(0), n)}


class Trainer:
    """Adagrad over the parameters of one partition, and how often each row was trained."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.p, self.vocabulary, self.done = p, vocabulary, 0
        self.seen = {k: np.zeros_like(v) for k, v in p.items()}
        self.times = {k: np.zeros(len(p[k]), np.int64) for k in ("embed", "node")}

    def step(self, ids: np.ndarray) -> None:
        self.done += int((ids[REACH:-REACH] != PAD).sum())
        for k, (rows, g, times) in gradients(self.p, self.vocabulary, ids).items():
            if rows is None:
                self.seen[k] += g * g
                self.p[k] -= (RATE * g / np.sqrt(self.seen[k] + 1e-8)).astype(np.float32)
                continue
            past = g * g
            past += self.seen[k].take(rows, axis=0)
            self.seen[k][rows] = past
            past += 1e-8
            np.sqrt(past, out=past)
            np.divide(g, past, out=past)
            past *= -RATE
            past += self.p[k].take(rows, axis=0)
            self.p[k][rows] = past
            self.times[k][rows] += times


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of HIDDEN + 1: those of the ids, of the nodes, of the hidden layer."""
    wide = lambda x: np.concatenate([x, np.zeros((len(x), HIDDEN + 1 - x.shape[1]), np.float32)], axis=1)
    return np.concatenate([wide(p["embed"]), p["node"], wide(p["in"].reshape(-1, HIDDEN)), wide(p["b"][None])])


def unpacked(x: np.ndarray, ids: int) -> dict[str, np.ndarray]:
    layer = len(x) - 2 * REACH * WIDTH - 1
    return {"embed": x[:ids, :WIDTH].copy(), "node": x[ids:layer].copy(), "in": x[layer:-1, :HIDDEN].reshape(WIDTH, -1).copy(), "b": x[-1, :HIDDEN].copy()}


_ENCODED = "row long, doc_id long, n_tokens long, ids binary, less double, rare array<struct<word:binary,tf:long>>"


def _encode_part(vocabulary_sent):
    """Of each text the ids of its words, what its rare words' buckets weigh, and those words, whose counts are to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_sent.value
        ids = vocabulary.lookup()
        for batch in batches:
            rows, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes, bodies, less, first, held, names, times, ends = [], [], [], 0, 0, [], [], [0]

            def out(stop: int) -> pa.RecordBatch:
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["word", "tf"]))
                return pa.RecordBatch.from_pydict({"row": pa.array(rows[first:stop], pa.int64()), "doc_id": pa.array(docs[first:stop], pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.array(bodies, pa.binary()), "less": pa.array(less, pa.float64()), "rare": rare})

            for k, t in enumerate(batch.column(2).to_pylist()):
                parts, rare = [], Counter()
                for w in words(t):
                    x = np.fromiter(map(ids.__getitem__, w), np.int32, len(w))
                    parts.append(x)
                    rare.update([w[i] for i in np.flatnonzero((x >= VOCABULARY) & (x < PAD)).tolist()])
                x = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                bodies.append(x.astype("<i4").tobytes())
                sizes.append(len(x))
                less.append(float(vocabulary.log_rare[x[(x >= VOCABULARY) & (x < PAD)] - VOCABULARY].sum()))
                names.extend(rare)
                times.extend(rare.values())
                ends.append(len(names))
                held += len(x)
                if held >= 16 * _BLOCK:
                    yield out(k + 1)
                    sizes, bodies, less, first, held, names, times, ends = [], [], [], k + 1, 0, [], [], [0]
            if bodies:
                yield out(len(rows))

    return run


_EDGE = np.full(REACH, PAD, np.int32)


def _train_part(sent, vocabulary_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_sent.value
        start = np.frombuffer(sent.value, np.float32).reshape(-1, HIDDEN + 1)
        trainer = Trainer(unpacked(start, vocabulary.size), vocabulary)
        held, size = [_EDGE], 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                held += [np.frombuffer(body, "<i4"), _EDGE]
                size += len(held[-2])
                if size >= 2 * _BLOCK:
                    _steps(trainer, np.concatenate(held))
                    held, size = [_EDGE], 0
        if size:
            _steps(trainer, np.concatenate(held))
        if trainer.done:
            layer = np.full(2 * REACH * WIDTH + 1, trainer.done)
            weights = np.concatenate([trainer.times["embed"], trainer.times["node"], layer])
            yield from _sent(TaskContext.get().partitionId(), np.flatnonzero(weights), packed(trainer.p), weights)

    def _steps(trainer: Trainer, ids: np.ndarray) -> None:
        """Runs of texts with PAD around each, in a seeded order."""
        starts = np.arange(REACH, len(ids) - REACH, BATCH)
        for a in np.random.default_rng(len(ids)).permutation(starts):
            trainer.step(ids[a - REACH : min(a + BATCH, len(ids) - REACH) + REACH])

    return run


def _sent(part: int, rows: np.ndarray, values: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that were trained, by blocks of _ROWS rows of the parameters; values and weights are of all rows."""
    for block in np.unique(rows // _ROWS):
        own = rows[rows // _ROWS == block]
        one = {"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "rows": pa.array([own.astype(np.int64).tobytes()], pa.binary())}
        yield pa.RecordBatch.from_pydict(one | {"n": pa.array([weights[own].astype(np.int64).tobytes()], pa.binary()), "body": pa.array([values[own].astype(np.float32).tobytes()], pa.binary())})


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the (block, part) groups dealt to a task, sorted by them and so held one at a time: means weighted by how often a row was trained."""
    now, sums, n = None, None, None

    def out() -> Iterator[pa.RecordBatch]:
        if now is not None:
            some = np.flatnonzero(n)
            block, part = now
            one = {"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "rows": pa.array([(block * _ROWS + some).tobytes()], pa.binary())}
            yield pa.RecordBatch.from_pydict(one | {"n": pa.array([n[some].tobytes()], pa.binary()), "body": pa.array([(sums[some] / n[some, None]).astype(np.float32).tobytes()], pa.binary())})

    for batch in batches:
        for block, part, rows, times, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if now != (block, part):
                yield from out()
                now, sums, n = (block, part), np.zeros((_ROWS, HIDDEN + 1)), np.zeros(_ROWS, np.int64)
            at, w = np.frombuffer(rows, np.int64) - block * _ROWS, np.frombuffer(times, np.int64)
            sums[at] += np.frombuffer(body, np.float32).reshape(-1, HIDDEN + 1).astype(np.float64) * w[:, None]
            n[at] += w
    yield from out()


_PARAMETERS = "block int, part int, rows binary, n binary, body binary"


def own_words(total: int) -> int:
    """How many words of a corpus of so many tokens are tokens of their own: with the cube root, so that any worker can hold them."""
    return max(VOCABULARY, round(40 * total ** (1 / 3)))


def vocabulary_of(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Counts every word of every text. The vocabulary, and word, n of all words beyond it; only the most frequent, ties by bytes, come to the driver.

    A histogram of the counts tells how frequent a word must be to come into question, so that no task
    sends a list of its own candidates: between one and a few times that many words are sorted at all.
    """
    counts = scratch(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    levels = counts.groupBy(F.floor(4 * F.log2("n")).alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    above, least, n = 0, 1, int(sum(r["n"] for r in levels))
    for r in sorted(levels, key=lambda r: -r["level"]):
        above, least = above + r["words"], r["least"]
        if above >= own_words(n):
            break
    rows = [(bytes(r["word"]), int(r["n"])) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(own_words(n)).collect()]
    rare = counts.where(F.lit(False))
    if rows:
        rare = counts.where((F.col("n") < rows[-1][1]) | ((F.col("n") == rows[-1][1]) & (F.col("word") > F.lit(rows[-1][0]))))
    masses = rare.groupBy((F.crc32("word") % RARE).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    return Vocabulary(rows, n, {int(r["bucket"]): int(r["n"]) for r in masses}), rare


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after `rounds` passes over every position of encoded (ids binary)."""
    sc = encoded.sparkSession.sparkContext
    told, values = sc.broadcast(vocabulary), packed(initial(vocabulary))
    for _ in range(rounds):
        sent = sc.broadcast(values.tobytes())
        parts = scratch(encoded.select("ids").mapInArrow(_train_part(sent, told), _PARAMETERS), "trained")
        while True:
            most = parts.agg(F.max("part")).first()[0] or 0
            grouped = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
            parts = grouped.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_average, _PARAMETERS)
            if most < FAN_IN:
                break
            parts = scratch(parts, "averaged")
        for r in parts.collect():  # the parameters, once
            values[np.frombuffer(r["rows"], np.int64)] = np.frombuffer(r["body"], np.float32).reshape(-1, HIDDEN + 1)
    return unpacked(values, vocabulary.size)


class Network:
    """Trained tables: for each side position the hidden contribution of every id."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.tables = [p["embed"] @ w for w in _blocks(p["in"])]
        self.b, self.node = p["b"], p["node"]

    def log_probs(self, ids: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """log p(token | both sides) at the positions of a padded sequence."""
        out = np.empty(len(at))
        top, bias = self.node[:DENSE, :HIDDEN], self.node[:, HIDDEN]
        for a in range(0, len(at), _AT_ONCE):
            k = at[a : a + _AT_ONCE]
            h = self.b + sum(table.take(ids[k + side - REACH], axis=0) for table, side in zip(self.tables, _SIDES, strict=True))
            np.tanh(h, out=h)
            total = np.ones(len(k))
            for paths, nodes, turns, dense in ((vocabulary.top_at, vocabulary.top_nodes, vocabulary.top_turns, True), (vocabulary.rest_at, vocabulary.rest_nodes, vocabulary.rest_turns, False)):
                path, count = _spans(paths, ids[k])
                if not len(path):
                    continue
                own = nodes[path]
                if dense:
                    z = (h @ top.T).ravel().take(np.repeat(np.arange(0, DENSE * len(k), DENSE), count) + own)
                else:
                    z = np.einsum("ij,ij->i", np.repeat(h, count, axis=0), self.node.take(own, axis=0)[:, :HIDDEN])
                z += bias.take(own)
                z *= 1 - 2 * turns[path]
                # the product of a path's decisions, each at least e**-60: one logarithm a position
                np.exp(np.minimum(z, 60, out=z), out=z)
                z += 1
                p = np.reciprocal(z, out=z).astype(np.float64)
                some = np.flatnonzero(count)
                total[some] *= np.multiply.reduceat(p, (np.cumsum(count) - count)[some])
            out[a : a + len(k)] = np.log(np.maximum(total, 1e-300))
        return out


def score_texts(texts: list[np.ndarray], vocabulary: Vocabulary, network: Network) -> list[float]:
    """Summed log-probabilities of id sequences."""
    if not texts:
        return []
    parts = [a for x in texts for a in (_EDGE, x)] + [_EDGE]
    ids = np.concatenate(parts)
    at = np.flatnonzero(ids != PAD)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    return np.bincount(owner, network.log_probs(ids, at, vocabulary), len(texts)).tolist()


def _score_part(vocabulary_sent, network_sent):
    """Of each encoded text the log-probability of its tokens, with rare words at one over their buckets' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = vocabulary_sent.value, network_sent.value
        for batch in batches:
            texts, sums, held, block = batch.column(1).to_pylist(), [], 0, []
            for body in texts:
                block.append(np.frombuffer(body, "<i4"))
                held += len(block[-1])
                if held >= 8 * _BLOCK:
                    sums += score_texts(block, vocabulary, network)
                    block, held = [], 0
            sums += score_texts(block, vocabulary, network)
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "doc_id": batch.column(2), "n_tokens": batch.column(3), "log_prob": pa.array(np.array(sums) - batch.column(4).to_numpy(), pa.float64())})

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed), mean_log_prob (null without tokens) for each row of docs.

    Null and empty texts have no tokens and log_prob 0. Repeated rows score alike. Long texts are read
    whole, in pieces. Other columns are not read; an empty table gives an empty result. Every word of the
    texts has been counted, so none is unseen. The model follows from the corpus and the way its files are
    split into partitions.
    """
    one_thread(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    vocabulary, rare = vocabulary_of(docs)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = scratch(texts.mapInArrow(_encode_part(sc.broadcast(vocabulary)), _ENCODED), "encoded")
    network = Network(train(encoded, vocabulary))
    scored = encoded.select("row", "ids", "doc_id", "n_tokens", "less").mapInArrow(_score_part(sc.broadcast(vocabulary), sc.broadcast(network)), "row long, doc_id long, n_tokens long, log_prob double")
    # a word that occurs once adds log 1 = 0; frequent words are not here, so no key is hot
    known = rare.where("n > 1").select("word", F.log("n").alias("log_n"))
    found = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(known.hint("shuffle_hash"), "word")
    more = found.groupBy("row").agg(F.sum(F.col("tf") * F.col("log_n")).alias("more"))
    rows = scored.join(more, "row", "left").select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    return rows.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
