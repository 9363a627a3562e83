"""Language identification by a bidirectional gated recurrent network over bytes.

Trained on the driver, in numpy, by backpropagation through time on a bounded sample of labelled rows;
applied on executors to every byte of every text: texts are cut into windows of WIDTH bytes, each read
from both ends, each position gets a distribution over languages, and a document's score is its mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import bounded_batches, one_thread

UNDETERMINED = "und"
HIDDEN, WIDTH = 12, 64
#: Bounds of the training sample: documents a language, documents in all, windows a document (more where documents are few).
DOCS_A_LANGUAGE, DOCS_IN_ALL, WINDOWS_A_DOC = 1500, 30_000, (2, 16)
#: Steps of gradient descent, and windows in each.
STEPS, BATCH = 450, 96
ROWS_AT_ONCE, BYTES_AT_ONCE = 2048, 2_000_000
PREDICTION = "lang_pred string, score double, positions array<long>, clearest double"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the right 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """One direction: tables of the input projections by byte, and recurrent weights, for gates z, r and candidate c."""

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        self.p = {f"x{g}": (0.3 * rng.standard_normal((256, hidden))).astype(np.float32) for g in "zrc"}
        self.p |= {f"h{g}": (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32) for g in "zrc"}

    def forward(self, steps: np.ndarray, keep: bool = False):
        """steps: (time, rows) bytes. Hidden states (time, rows, hidden), and what the way back needs."""
        p, (n, rows) = self.p, steps.shape
        width = p["hz"].shape[0]
        out, h, kept = np.empty((n, rows, width), np.float32), np.zeros((rows, width), np.float32), []
        for t in range(n):
            x = steps[t]
            z, r, c = h @ p["hz"], h @ p["hr"], h @ p["hc"]
            z += np.take(p["xz"], x, axis=0)
            r += np.take(p["xr"], x, axis=0)
            z, r = _sigmoid(z), _sigmoid(r)
            u = c.copy() if keep else None
            c *= r
            c += np.take(p["xc"], x, axis=0)
            np.tanh(c, out=c)
            if keep:
                kept.append((h, z, r, u, c))
            z_c = c - h
            z_c *= z
            h = np.add(h, z_c, out=out[t])
        return out, kept

    def backward(self, steps: np.ndarray, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters from those of the hidden states, through time."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(grad[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, u, c = kept[t]
            dh = dh + grad[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            du = dc * r
            for name, d in (("xz", dz), ("xr", dr), ("xc", dc)):
                np.add.at(g[name], steps[t], d)
            g["hz"] += h.T @ dz
            g["hr"] += h.T @ dr
            g["hc"] += h.T @ du
            dh = dh * (1 - z) + dz @ p["hz"].T + dr @ p["hr"].T + du @ p["hc"].T
        return g


class Model:
    """Both directions and the softmax over languages at every position."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.fwd, self.bwd = langs, ByteGru(rng), ByteGru(rng)
        self.out = {"f": (0.3 * rng.standard_normal((HIDDEN, len(langs)))).astype(np.float32), "b": (0.3 * rng.standard_normal((HIDDEN, len(langs)))).astype(np.float32), "o": np.zeros(len(langs), np.float32)}

    def positions(self, rows: np.ndarray, keep: bool = False):
        """rows: (rows, time) bytes. Probabilities (time, rows, languages)."""
        steps = np.ascontiguousarray(rows.T)
        hf, kf = self.fwd.forward(steps, keep)
        hb, kb = self.bwd.forward(steps[::-1], keep)
        hb = hb[::-1]
        p = hf @ self.out["f"]
        p += hb @ self.out["b"]
        p += self.out["o"]
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p, (steps, hf, hb, kf, kb)

    def labels(self, rows: np.ndarray) -> np.ndarray:
        """The same probabilities by language, (languages, time, rows): languages are few, so each is a plane."""
        steps = np.ascontiguousarray(rows.T)
        hf, _ = self.fwd.forward(steps)
        hb, _ = self.bwd.forward(steps[::-1])
        shape = (len(self.langs), *steps.shape)
        p = (self.out["f"].T @ hf.reshape(-1, HIDDEN).T).reshape(shape)
        p += (self.out["b"].T @ hb.reshape(-1, HIDDEN).T).reshape(shape)[:, ::-1]
        p += self.out["o"][:, None, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def step(self, rows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> list[tuple[dict, dict]]:
        """(parameters, gradients) of the mean cross-entropy over all positions."""
        p, (steps, hf, hb, kf, kb) = self.positions(rows, keep=True)
        d = p
        d[:, np.arange(len(rows)), labels] -= 1
        d *= (mask.T / max(mask.sum(), 1))[:, :, None].astype(np.float32)
        flat = d.reshape(-1, d.shape[2])
        go = {"f": hf.reshape(-1, HIDDEN).T @ flat, "b": np.ascontiguousarray(hb).reshape(-1, HIDDEN).T @ flat, "o": flat.sum(0)}
        gf = self.fwd.backward(steps, kf, d @ self.out["f"].T)
        gb = self.bwd.backward(steps[::-1], kb, (d @ self.out["b"].T)[::-1])
        return [(self.fwd.p, gf), (self.bwd.p, gb), (self.out, go)]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean probabilities (texts, languages), the number of positions labelled with each language, and the highest mean that a language has in any window."""
        n_langs = len(self.langs)
        sums, votes = np.zeros((len(texts), n_langs)), np.zeros((len(texts), n_langs), np.int64)
        clearest = np.zeros(len(texts))
        for first, rows, mask, owner in _windows(texts):
            p = self.labels(rows)
            m = np.ascontiguousarray(mask.T)
            p *= m
            best, top = np.zeros(m.shape, np.int16), p[0].copy()
            for k in range(1, n_langs):
                over = p[k] > top
                best[over] = k
                np.maximum(top, p[k], out=top)
            most = np.zeros(len(owner))
            for k in range(n_langs):
                own = p[k].sum(0, dtype=np.float64)
                np.maximum(most, own, out=most)
                sums[:, k] += np.bincount(owner, own, len(texts))
                votes[:, k] += np.bincount(owner, ((best == k) & m).sum(0), len(texts)).astype(np.int64)
            np.maximum.at(clearest, owner, most / np.maximum(m.sum(0), 1))
        return sums / np.maximum([[len(t)] for t in texts], 1), votes, clearest


def _windows(texts: list[bytes]):
    """Blocks of windows over whole texts: bytes, mask, the text of each row. The last window of a text is padded."""
    counts = np.array([-(-len(t) // WIDTH) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    data = b"".join(t + bytes(-len(t) % WIDTH) for t in texts)
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    ends = np.cumsum(counts)
    used = np.full(len(rows), WIDTH)
    some = counts > 0
    used[ends[some] - 1] = [len(t) - (len(t) - 1) // WIDTH * WIDTH for t in texts if t]
    for a in range(0, len(rows), ROWS_AT_ONCE):
        part = slice(a, a + ROWS_AT_ONCE)
        yield a, rows[part], np.arange(WIDTH) < used[part, None], owner[part]


def train(samples: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> Model | None:
    """samples: (lang, text window); Adam over windows in seeded order. None: nothing to learn from."""
    samples = sorted((lang, t.encode()[:WIDTH]) for lang, t in samples if lang is not None and t)
    if not samples:
        return None
    langs = sorted({lang for lang, _ in samples})
    model, rng = Model(langs, seed), np.random.default_rng(seed)
    labels = np.array([langs.index(lang) for lang, _ in samples])
    rows = np.frombuffer(b"".join(t + bytes(WIDTH - len(t)) for _, t in samples), np.uint8).reshape(-1, WIDTH)
    mask = np.arange(WIDTH) < np.array([[len(t)] for _, t in samples])
    # every language weighs alike: rare ones are shown as often as frequent ones
    share = 1 / np.bincount(labels)[labels]
    share /= share.sum()
    state = {}
    for k in range(1, steps + 1):
        pick = rng.choice(len(samples), batch, p=share)
        lr = rate * (1 - 0.9 * k / steps) * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        for params, grads in model.step(rows[pick], labels[pick], mask[pick]):
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m, v = state.setdefault((id(params), name), [np.zeros_like(g), np.zeros_like(g)])
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[name] -= (lr * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 on division by 3; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, window) pairs from rows that are not held out: at most DOCS_IN_ALL documents, an equal quota for each language.

    Rows are chosen by hash below a threshold that their language's count gives; 2 to 16 windows of each
    document are taken at hashed positions, so no more than that is sent to the driver.
    """
    one_thread(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(DOCS_IN_ALL).collect()}
    if not counts:
        return []
    quota = max(1, min(DOCS_A_LANGUAGE, DOCS_IN_ALL // len(counts)))
    bars = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, quota / n) * 1_000_000))])
    chosen = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(bars, F.col("lang"))) & F.col("text").rlike(r"\p{L}"))
    least, most = WINDOWS_A_DOC
    each = max(least, min(most, 2 * DOCS_A_LANGUAGE * len(counts) // max(1, sum(counts.values()))))
    at = lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WIDTH + 1, F.lit(1))) + 1).cast("int"), F.lit(WIDTH))
    got = chosen.select("lang", F.array(*[at(k) for k in range(each)]).alias("w")).limit(2 * DOCS_IN_ALL).collect()
    return [(r["lang"], w) for r in got for w in r["w"]]


def predictor(model: Model | None):
    """A column function from text to struct(lang_pred, score, positions)."""

    @F.pandas_udf(PREDICTION)
    def predict(text: pd.Series) -> pd.DataFrame:
        pred, score, positions, clear = [], [], [], []
        block, size = [], 0

        def flush() -> None:
            nonlocal size
            known = [b for b in block if b]
            means, votes, clearest = model.predict(known) if known else (None, None, None)
            k = 0
            for b in block:
                if b:
                    best = int(means[k].argmax())
                    pred.append(model.langs[best])
                    score.append(float(min(1.0, max(0.0, means[k, best]))))
                    positions.append(votes[k].tolist())
                    clear.append(float(clearest[k]))
                    k += 1
                else:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    positions.append([])
                    clear.append(0.0)
            block.clear()
            size = 0

        for t in text:
            block.append(t.encode() if t and model else b"")
            size += len(block[-1])
            if size >= BYTES_AT_ONCE:
                flush()
        flush()
        return pd.DataFrame({"lang_pred": pred, "score": score, "positions": positions, "clearest": clear})

    return lambda text: predict(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs' columns doc_id and held_out, lang_pred, score, positions (bytes labelled with each learned language, in order).

    Null texts and texts without a letter are 'und' with score 0; so is everything where no row can be
    learned from. Rows are judged by their text alone: repeated rows alike, whatever their lang, source
    and doc_id say; other columns are not read; an empty table gives an empty result.
    """
    model = train(sample(docs)) if model is None else model
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)(F.col("text")).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.positions")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without the rows it rejects: texts without a letter, and those that are no language in any of their windows.

    A window is none where no language has `least` of its probability, nor half as much again as all would
    have alike; so a text in several languages stays, and many languages lower the bar. Where no row can be
    learned from, every text with a letter stays.
    """
    model = train(sample(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    p, bar = predictor(model)(F.col("text")), min(least, 1.5 / len(model.langs))
    rows = docs.select(F.struct("*").alias("_row"), p.alias("_p")).where((F.col("_p.lang_pred") != UNDETERMINED) & (F.col("_p.clearest") >= bar))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
