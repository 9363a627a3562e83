"""Language identification, language-model scoring and packing."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import language_id, lm_score, packing, tokens
from scholia.llm.queries import op1_lm_score, op2_packing, op3_language_id, tokenizer_path

ODD = [(1, None), (2, ""), (3, "..."), (4, "42 \n"), (5, "one"), (5, "one"), (None, "the and of"), (6, "é"), (7, "word and " * 20_000), (8, "<|endoftext|> x"), (9, "a\x85b\xa0c \x1c d"), (10, "日本語 😀 Straße ñ ñ İ ΑΣ it's x_y 1½")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, 2, 3) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, score int")


def test_language_id_held_out(spark, sf):
    got = {r["doc_id"]: r for r in op3_language_id(spark, sf).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    held = [d for d in docs if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[d]["lang_pred"] == docs[d]["lang"] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_odd_rows(spark, sf):
    model = language_id.train([("en", "the and of that was"), ("fr", "le de la que est")] * 20, steps=20)
    got = language_id.identify(table(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    und = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert sorted(und) == [1, 2, 3, 4] and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    whole = next(r for r in got if r["doc_id"] == 7)
    assert sum(whole["positions"]) == len(("word and " * 20_000).encode())
    assert language_id.identify(table(spark, ODD).limit(0)).count() == 0
    blind = language_id.identify(table(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}
    kept = language_id.keep_identified(table(spark, ODD))
    assert kept.columns == table(spark, ODD).columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 4})


def test_clean_documents_stay(spark):
    one = {"aa": "abcab acbca ", "bb": "klmkl mklmk ", "cc": "xyzxy zyxyz "}
    rows = [(lang, 100 * i + k, t * 12) for i, (lang, t) in enumerate(one.items()) for k in range(30)]
    rows += [(None, 999, "".join(t * 20 for t in one.values())), (None, 1000, "12 34")]
    d = spark.createDataFrame([(k, t, lang) for lang, k, t in rows], "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(d))
    score = {r["doc_id"]: r["score"] for r in language_id.identify(d, model).collect()}
    assert score[999] < 0.4  # its mean is about a third in each language
    assert {r["doc_id"] for r in language_id.keep_identified(d).collect()} == {k for _, k, _ in rows} - {1000}
    blind = language_id.keep_identified(table(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert sorted(str(r["doc_id"]) for r in blind.collect()) == sorted(str(d) for d, _ in ODD if d not in (1, 2, 3, 4))


def test_gru_gradients():
    model = language_id.Model(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(0)
    rows, labels, mask = rng.integers(0, 256, (4, 9)).astype(np.uint8), np.array([0, 1, 2, 0]), np.arange(9) < np.array([[9], [5], [1], [7]])
    for part in (model.fwd.p, model.bwd.p, model.out):
        for k in part:
            part[k] = part[k].astype(np.float64)

    def loss():
        p, _ = model.positions(rows)
        return -(np.log(p[:, np.arange(4), labels]) * mask.T).sum() / mask.sum()

    for params, grads in model.step(rows, labels, mask):
        for name, g in grads.items():
            at = np.unravel_index(np.abs(g).argmax(), g.shape)
            old, eps = params[name][at], 1e-2
            params[name][at] = old + eps
            up = loss()
            params[name][at] = old - eps
            down = loss()
            params[name][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.05, abs=2e-4), name


def test_encoder_is_the_tokenizer(sf, spark):
    enc = tokens.ChunkEncoder(tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [t for _, t in ODD if t]
    for t in texts:
        assert enc.encode(t) == np.array(enc.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_looks_up_each_chunk_once(monkeypatch):
    path = tokenizer_path()
    enc, asked = tokens.ChunkEncoder(path), []
    texts = ["Don't stop 12,5 it's ÀÉÎÕÜ_ß...", None, "", "  \t\n", "a\x1cb c\x85d\xa0e\u2028f", "x<|endoftext|>y", "日本 “q” it's don't DON'T ΑΣ İ ẞ"] + ["the cat The CAT sat"] * 50
    texts += ["".join(map(chr, range(256))), "".join(f"{chr(c)}x " for c in range(256)), "é" * 100_000]
    chunk = tokens.ChunkEncoder._chunk
    monkeypatch.setattr(tokens.ChunkEncoder, "_chunk", lambda self, c: asked.append(c) or chunk(self, c))
    got = enc.encode_all(pa.array(texts))
    assert [g.tolist() for g in got] == [enc.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) and enc.encode_all(pa.array([], pa.string())) == []
    # what a worker keeps is bounded in number and in length
    assert max(map(len, enc.pieces)) <= tokens.SHORT
    monkeypatch.setattr(tokens, "REMEMBER", 20)
    enc.encode_all(pa.array([" ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop日本")]))
    assert len(enc.pieces) <= 20 and len(enc.odd) <= 20


def test_pieces_come_in_bounded_batches():
    group = pa.table({"doc_id": list(range(40)), "text": ["a b c d " * 20_000] * 40, "shard": [0] * 40})
    out = packing._pack_group(tokenizer_path(), packing.WINDOW, packing.END)(group)
    assert sum(out["length"].to_pylist()) == 40 * 80_001 and max(b.nbytes for b in out.to_batches()) < 5_000_000


def check_packing(pieces, docs, path, window=packing.WINDOW):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = Counter()
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    by, seqs = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= window
    got = Counter()
    for d, rs in by.items():
        rs.sort(key=lambda r: (r["start"], r["sequence_id"]))
        whole = [r for r in rs if r["length"] == r["doc_tokens"]]
        for r in whole:
            got[(d, r["doc_tokens"], zlib.crc32(bytes(r["ids"])))] += 1
        cut = [r for r in rs if r["length"] < r["doc_tokens"]]
        if cut:
            assert [r["start"] for r in cut] == list(np.cumsum([0] + [r["length"] for r in cut[:-1]]))
            got[(d, cut[0]["doc_tokens"], zlib.crc32(b"".join(bytes(r["ids"]) for r in cut)))] += 1
    assert got == want
    return [sum(n for _, n in s) for s in seqs.values()]


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = check_packing(packing.pack(docs, tokenizer_path(), shard_bytes=100_000).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer_path())
    assert sum(n < packing.WINDOW for n in lengths) <= docs.agg(F.sum(F.octet_length("text") + packing.ROW_BYTES)).first()[0] // 100_000 + 1
    odd = table(spark, ODD)
    check_packing(packing.pack(odd, tokenizer_path()).collect(), ODD, tokenizer_path())
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0
    assert sorted(map(str, op2_packing(spark, sf).collect())) == sorted(map(str, op2_packing(spark, sf).collect()))


def test_bm25_finds_its_own_kind():
    rng = np.random.default_rng(1)
    docs = [np.concatenate([rng.integers(100 * (i % 4), 100 * (i % 4) + 40, 60), rng.integers(900, 950, 20), [2000 + i, 3000 + i // 2]]).astype("<u4") for i in range(40)]
    index = packing.Bm25Shard(docs)
    unused = np.ones(40, bool)
    unused[0] = False
    near = list(index.neighbours(0, unused))
    assert 0 not in near and all(i % 4 == 0 for i in near[:9]) and len(set(near)) == len(near)
    n, df = 40, Counter(t for d in docs for t in set(d.tolist()))
    avg = np.mean([len(d) for d in docs])
    own = Counter(docs[0].tolist())

    def weight(t, d):
        tf = d.tolist().count(t)
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))

    assert len(index.rows) and any(len(t) for t in index.sparse_of)
    assert index.scores(0) == pytest.approx([sum(weight(t, d) for t in own) for d in docs], rel=1e-4)


def test_bm25_queries_all_terms():
    # the seed's other terms are all heavier than the one that the second document shares
    docs = [np.array([*np.repeat(np.arange(1, 60), 3), 99], "<u4"), np.array([99, 200, 201], "<u4"), np.array([300, 301], "<u4"), np.array([400], "<u4")]
    index, unused = packing.Bm25Shard(docs), np.array([False, True, True, True])
    assert list(index.neighbours(0, unused)) == [1]


def test_lm_score(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op1_lm_score(spark, sf).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == words
    assert all(r["log_prob"] < 0 and r["mean_log_prob"] == pytest.approx(r["log_prob"] / r["n_tokens"]) for r in got)


def test_lm_odd_rows_and_learning(spark):
    rows = [(20_000 + i, "the cat sat on the mat and the dog ran " * 12) for i in range(400)] + [(1000 + i, "zu der von mit und ein ist das " * 12) for i in range(400)]
    mixed = "the zu cat der sat von on mit the und mat ein and ist the das dog zu ran der " * 6
    shuffled = (9999, " ".join(np.random.default_rng(2).permutation(mixed.split())))
    d = table(spark, rows + ODD + [shuffled])
    got = {r["doc_id"]: r for r in lm_score.score(d).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["log_prob"] == 0 and got[1]["mean_log_prob"] is None
    assert got[7]["n_tokens"] == 40_000
    assert got[20_000]["mean_log_prob"] > got[9999]["mean_log_prob"] + 0.5
    assert lm_score.score(d.limit(0)).count() == 0


def test_lm_is_normalised():
    vocabulary = lm_score.Vocabulary([(b"a", 10), (b"b", 5), (b"c", 1)], 20)
    p = lm_score.initial(vocabulary)
    ids = vocabulary.lookup()
    x = np.array([ids[w] for w in (b"a", b"b", b"rare", b"a")], np.int32)

    def all_of(net, left):
        out = {}
        for t in (0, 1, 2, *range(lm_score.VOCABULARY, lm_score.PAD)):
            y = np.concatenate([lm_score._EDGE, [left, t], x[2:], lm_score._EDGE]).astype(np.int32)
            out[t] = float(np.exp(net.log_probs(y, np.array([3]), vocabulary)[0]))
        return out

    probs = all_of(lm_score.Network(p), 0)
    assert sum(probs.values()) == pytest.approx(1.0, rel=1e-4)
    # words of like frequency answer to the context, each in its own way
    other = all_of(lm_score.Network(p), 1)
    ratios = [probs[a] / probs[b] / (other[a] / other[b]) for a, b in ((1, 2), (lm_score.VOCABULARY, lm_score.VOCABULARY + 1))]
    assert all(abs(math.log(r)) > 1e-4 for r in ratios)


def test_lm_starts_as_the_unigram():
    vocabulary = lm_score.Vocabulary([(b"a", 70), (b"b", 20), (b"c", 10)], 100, {})
    p = lm_score.initial(vocabulary)
    p["node"][:, : lm_score.HIDDEN] = 0
    y = np.concatenate([lm_score._EDGE, [0, 1, 2], lm_score._EDGE]).astype(np.int32)
    got = np.exp(lm_score.Network(p).log_probs(y, np.array([2, 3, 4]), vocabulary))
    n = np.array([70.5, 20.5, 10.5])
    assert got == pytest.approx(n / (n.sum() + 0.5 * lm_score.RARE), rel=1e-4)


@pytest.mark.parametrize("words", [3, 400])
def test_lm_gradients(words):
    """Finite differences of the mean loss, in double precision; with 400 words paths leave the dense nodes."""
    vocabulary = lm_score.Vocabulary([(b"w%d" % k, 1000 - 2 * k) for k in range(words)], 10**6, {0: 50})
    p = {k: v.astype(np.float64) for k, v in lm_score.initial(vocabulary).items()}
    assert (len(vocabulary.rest_nodes) > 100) == (words == 400)
    rng = np.random.default_rng(5)
    seq = np.concatenate([lm_score._EDGE, vocabulary.ids[rng.integers(0, words, 40)], [lm_score.VOCABULARY], lm_score._EDGE, vocabulary.ids[:3], lm_score._EDGE]).astype(np.int32)
    at = np.flatnonzero(seq != lm_score.PAD)

    def loss():
        return -lm_score.Network(p).log_probs(seq, at, vocabulary).mean()

    for name, (rows, g, _) in lm_score.gradients(p, vocabulary, seq).items():
        full = np.zeros_like(p[name])
        full[slice(None) if rows is None else rows] = g
        for k in np.argsort(-np.abs(full), axis=None)[:4]:
            where = np.unravel_index(k, full.shape)
            old = p[name][where]
            p[name][where] = old + 1e-5
            up = loss()
            p[name][where] = old - 1e-5
            down = loss()
            p[name][where] = old
            assert (up - down) / 2e-5 == pytest.approx(full[where], rel=1e-3, abs=1e-8), name


def test_lm_document_sum_is_a_plain_loop():
    vocabulary = lm_score.Vocabulary([(b"w%d" % k, 500 - k) for k in range(200)], 10**5)
    p = lm_score.initial(vocabulary)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 200, n).astype(np.int32) for n in (1, 2, 30, 0)]

    def plain(x):
        total = 0.0
        for i in range(len(x)):
            h = p["b"].astype(float)
            for j, k in enumerate((-2, -1, 1, 2)):
                token = x[i + k] if 0 <= i + k < len(x) else lm_score.PAD
                h = h + p["embed"][token].astype(float) @ p["in"][:, j * lm_score.HIDDEN : (j + 1) * lm_score.HIDDEN]
            h = np.tanh(h)
            for a in range(vocabulary.at[x[i]], vocabulary.at[x[i] + 1]):
                node = vocabulary.nodes[a]
                q = 1 / (1 + math.exp(-float(h @ p["node"][node, :-1] + p["node"][node, -1])))
                total += math.log(q if vocabulary.turns[a] else 1 - q)
        return total

    assert lm_score.score_texts(texts, vocabulary, lm_score.Network(p)) == pytest.approx([plain(x) for x in texts], rel=1e-5)


def test_lm_rare_words_have_their_own_share(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "own_words", lambda total: 4)
    # two rare words of one bucket, one of them fifty times as frequent
    often = b"often"
    seldom = next(w for w in (f"w{k}".encode() for k in range(9999)) if zlib.crc32(w) % lm_score.RARE == zlib.crc32(often) % lm_score.RARE)
    rows = [(i, "the cat sat on " * 40) for i in range(50)] + [(100 + i, "often") for i in range(50)] + [(200, seldom.decode())]
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.score(table(spark, rows)).collect()}
    assert got[100] - got[200] == pytest.approx(math.log(50), abs=1e-5)


def test_lm_vocabulary_grows():
    assert lm_score.own_words(10**3) == lm_score.VOCABULARY < lm_score.own_words(10**8) < lm_score.own_words(10**10)
    words = [(b"w%d" % k, 6000 - k) for k in range(5000)]
    vocabulary = lm_score.Vocabulary(words, 10**8, {0: 1000, 3: 7})
    ids = vocabulary.lookup()
    got = [ids[w] for w, _ in words]
    assert len(set(got)) == 5000 and not {lm_score.PAD, *range(lm_score.VOCABULARY, lm_score.PAD)}.intersection(got)
    paths = {tuple(zip(vocabulary.nodes[a:b].tolist(), vocabulary.turns[a:b].tolist(), strict=True)) for a, b in zip(vocabulary.at[:-1], vocabulary.at[1:], strict=True) if b > a}
    assert len(paths) == 5000 + lm_score.RARE and sum(2.0 ** -len(x) for x in paths) == 1.0
    p = lm_score.initial(vocabulary)
    again = lm_score.unpacked(lm_score.packed(p), vocabulary.size)
    assert all((p[k] == again[k]).all() for k in p) and len(p["embed"]) == 5000 + lm_score.RARE + 1


def trained(monkeypatch, vocabulary, texts, part=0):
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: part)))
    told = SimpleNamespace(value=vocabulary)
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(len(texts)), pa.int64()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    encoded = [x.select(["ids"]) for x in lm_score._encode_part(told)(iter([batch]))]
    sent = SimpleNamespace(value=lm_score.packed(lm_score.initial(vocabulary)).tobytes())
    return list(lm_score._train_part(sent, told)(iter(encoded)))


def test_lm_trains_on_every_position(monkeypatch):
    vocabulary = lm_score.Vocabulary([(b"a", 10), (b"b", 5)], 20)
    texts = ["a", "b a b", "a b " * 20_000, "", None, "b"]
    n = sum(len((t or "").split()) for t in texts)
    times = {}
    for x in trained(monkeypatch, vocabulary, texts):
        times |= dict(zip(np.frombuffer(x.column(2)[0].as_py(), np.int64), np.frombuffer(x.column(3)[0].as_py(), np.int64), strict=True))
    assert times[max(times)] == n  # the hidden layer
    assert times[vocabulary.size] == n  # the root
    words = Counter(w for t in texts for w in (t or "").split())
    assert vocabulary.size + vocabulary.count > max(times) - 70 and times[0] + times[1] < 4 * sum(words.values())


def test_lm_averages_in_a_tree(spark, monkeypatch):
    """Any fan-in gives the same weighted means, and rows that no partition trained keep their start."""
    words = "the cat sat on a mat".split()
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(20))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    vocabulary, _ = lm_score.vocabulary_of(d)
    told = spark.sparkContext.broadcast(vocabulary)
    texts = d.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    encoded = lm_score.scratch(texts.mapInArrow(lm_score._encode_part(told), lm_score._ENCODED), "encoded")
    whole = lm_score.train(encoded, vocabulary)
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    tree = lm_score.train(encoded, vocabulary)
    start = lm_score.initial(vocabulary)
    for k, v in whole.items():
        assert tree[k] == pytest.approx(v, rel=1e-4, abs=1e-5)
    assert (whole["embed"][lm_score.VOCABULARY] == start["embed"][lm_score.VOCABULARY]).all()
    assert (whole["embed"][:6] != start["embed"][:6]).any()
