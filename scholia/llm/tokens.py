"""Exact ids of a public word-level BPE, with memoised pieces.

The tokenizer's normaliser and pre-tokenizer never join text across ASCII white space, so a text's ids
are its chunks' ids, concatenated. Chunks of plain Latin letters go straight to the merge model; all
others, and texts that hold a special token's string, go through the whole tokenizer. Arrow
splits many texts at once, and each chunk that they hold is looked up once.
"""

from __future__ import annotations

import re
import struct
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a worker, at most (about 200 bytes each), as many odd chunks, and the characters of one.
REMEMBER, SHORT = 250_000, 64
#: Bytes of texts that are split at once.
AT_ONCE = 1 << 20


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """encode(text) -> bytes of little-endian unsigned 32-bit ids, as Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.symbols = {b: s for b, s in _byte_symbols().items()}
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
        self.odd: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # its own normal form, also when it is lower-cased
        self.simple = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
        return _remembered(self.pieces, piece, [t.id for t in self.model.tokenize(symbols)])

    def _chunk(self, chunk: str) -> bytes:
        got = self.pieces.get
        if chunk.isascii() and chunk.isalpha():
            piece = chunk.lower()
            return got(piece) or self._piece(piece)
        if self.simple.fullmatch(chunk):
            return b"".join([got(p) or self._piece(p) for p in self.split.findall(chunk.lower())])
        return self.odd.get(chunk) or _remembered(self.odd, chunk, self.whole.encode(chunk, add_special_tokens=False).ids)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is an empty one. Texts are taken in parts of about AT_ONCE bytes, each chunk of a part is looked up once."""
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return [ids for a, b in zip(cuts[:-1], cuts[1:], strict=True) for ids in self._encode_part(texts[a:b])]

    def _encode_part(self, texts: pa.Array) -> list[np.ndarray]:
        special = pc.is_null(texts)
        for s in self.specials:
            special = pc.or_(special, pc.match_substring(pc.fill_null(texts, ""), s))
        # they are empty among the others
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", texts))
        at, words = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        index, bodies = words.indices.to_numpy(), [self._chunk(w) for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        del lists, words
        flat, sizes = np.frombuffer(b"".join(bodies), dtype="<u4"), np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        starts, ends = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(sizes[index])])
        del bodies
        out = flat[np.repeat(starts[index] - ends[:-1], sizes[index]) + np.arange(ends[-1])]
        got = np.split(out, ends[at[1:-1]]) if len(texts) else []
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
            got[k] = np.array(self.whole.encode(texts[int(k)].as_py() or "", add_special_tokens=False).ids, dtype="<u4")
        return got

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()


def _remembered(kept: dict[str, bytes], key: str, ids: list[int]) -> bytes:
    out = struct.pack(f"<{len(ids)}I", *ids)
    if len(key) <= SHORT:
        if len(kept) >= REMEMBER:
            kept.clear()
        kept[key] = out
    return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process, kept between its tasks."""
    kept = sys.modules.setdefault("_scholia_kept", types.ModuleType("_scholia_kept"))
    name = f"encoder {path}"
    if not hasattr(kept, name):
        setattr(kept, name, ChunkEncoder(path))
    return getattr(kept, name)
