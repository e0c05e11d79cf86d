"""Byte-level BPE ids of many texts at once, equal to the ``tokenizers`` library's.

Words repeat: a slice of texts is cut into the vocabulary's pre-tokens with
array operations on code points, only its distinct pre-tokens are encoded, and
ids are gathered back.  Texts with letters outside the Latin blocks, or with an
apostrophe before a letter (contractions), go through the library whole.  Texts
are first cut at the vocabulary's added tokens, which have ids of their own.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
import zlib

import numpy as np

from . import textkit as tk

#: code points below this have the same category in every Unicode version in use
LATIN = 0x250
_KIND = np.full(LATIN, 3, np.uint8)  # 0 white space, 1 letter, 2 number, 3 other
for _c in range(LATIN):
    _cat = unicodedata.category(chr(_c))
    _KIND[_c] = 1 if _cat[0] == "L" else 2 if _cat[0] == "N" else 3
_KIND[[*range(9, 14), 0x20, 0x85, 0xA0]] = 0


def load_encoding(path: str | None = None):
    """tiktoken encoding of the byte-level vocabulary (``path``: its rank file)."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Added tokens of the vocabulary's json file (beside the rank file), which a text may spell out."""
    import public_tokenizers as P

    name = P.path("byte_bpe_50k.json") if path is None else os.path.splitext(path)[0] + ".json"
    if path is not None and not os.path.exists(name):
        return {}
    with open(name, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class BpeCounter:
    """Encoder with a bounded memory of pre-tokens (``most`` entries, then it starts anew)."""

    def __init__(self, path: str | None = None, most: int = 1_000_000):
        self.enc, self.most, self.added = load_encoding(path), most, added_tokens(path)
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(longest) + ")") if longest else None
        self.width = np.array([len(self.enc.decode_single_token_bytes(i)) for i in range(self.enc.max_token_value + 1)], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the known pre-tokens
        self.begin = np.zeros(0, np.int64)  # their ids: pool[begin:begin + size]
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        """Encode new pre-tokens.  Those of a space and letters split the same when joined, so one call does them all."""
        plain = (cp[start] == 0x20) & (_KIND[cp[np.minimum(start + 1, end - 1)]] == 1)
        size, chunks = np.zeros(len(keys), np.int64), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        if n:
            long = (end - start)[order[:n]]
            to = np.cumsum(long)
            joined = cp[np.repeat(start[order[:n]] - (to - long), long) + np.arange(to[-1])]
            ids = np.array(self.enc.encode_ordinary(joined.tobytes().decode("utf-32-le")), np.uint32)
            bytes_to = np.cumsum(np.where(joined < 0x80, 1, 2))[to - 1]
            to = np.searchsorted(np.cumsum(self.width[ids]), bytes_to) + 1
            size[:n] = np.diff(to, prepend=0)
            chunks.append(ids)
        for k in range(n, len(order)):
            ids = self.enc.encode_ordinary(cp[start[order[k]]:end[order[k]]].tobytes().decode("utf-32-le"))
            size[k] = len(ids)
            chunks.append(np.array(ids, np.uint32))
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *chunks])
        keys = np.concatenate([self.keys, keys[order]])
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.begin = np.concatenate([self.begin, begin])[by]
        self.size = np.concatenate([self.size, size])[by]

    def _places(self, u: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; offsets of the texts)."""
        if len(self.keys) > self.most:
            self._reset()
        out: list[np.ndarray | None] = [None] * len(texts)
        fast: list[int] = []
        points: list[np.ndarray] = []
        for i, t in enumerate(texts):
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(cp) == 0:
                out[i] = np.zeros(0, np.uint32)
            elif self.cuts and self.cuts.search(t):
                parts = self.cuts.split(t)  # text, added token, text, ...
                out[i] = np.array([x for k, p in enumerate(parts) for x in ([self.added[p]] if k % 2 else self.enc.encode_ordinary(p))], np.uint32)
            elif int(cp.max()) >= LATIN or _contraction(cp):
                out[i] = np.array(self.enc.encode_ordinary(t), np.uint32)
            else:
                fast.append(i)
                points.append(cp)
        if fast:
            cp = np.concatenate(points)
            off = np.zeros(len(fast) + 1, np.int64)
            np.cumsum([len(p) for p in points], out=off[1:])
            start, end = pretokens(cp, off)
            data = cp.astype("<u2").view(np.uint8)
            h = tk.span_hash(data, 2 * start, 2 * end)
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            at = self._places(u)
            new = np.flatnonzero(self.keys[at] != u) if len(self.keys) else np.arange(len(u))
            if len(new):
                self._learn(cp, start[first[new]], end[first[new]], u[new])
                at = self._places(u)
            at = at[back]
            size = self.size[at]
            total = np.zeros(len(at) + 1, np.int64)
            np.cumsum(size, out=total[1:])
            ids = self.pool[np.repeat(self.begin[at] - total[:-1], size) + np.arange(total[-1])]
            doc = np.searchsorted(start, off)
            for k, i in enumerate(fast):
                out[i] = ids[total[doc[k]]:total[doc[k + 1]]]
        lengths = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=lengths[1:])
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), lengths

    def pieces(self, col, seq_len: int, end_id: int = 0):
        """For each slice: (first row, end row, (row, piece, start, length, crc32) arrays)."""
        _, off = tk.text_bytes(col)
        texts = col.to_pylist()
        for i, j in tk.slices(off):
            ids, at = self.encode([t or "" for t in texts[i:j]])
            rows: tuple[list, ...] = ([], [], [], [], [])
            for r in range(j - i):
                own = np.append(ids[at[r]:at[r + 1]], np.uint32(end_id)).astype("<u4")
                n = len(own)
                cuts = [0, n] if n <= seq_len else [0, *range(n % seq_len or seq_len, n + 1, seq_len)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for x, v in zip(rows, (r, p, a, b - a, zlib.crc32(own[a:b]))):
                        x.append(v)
            yield i, j, tuple(np.array(x, np.int64) for x in rows)


def _contraction(cp: np.ndarray) -> bool:
    at = np.flatnonzero(cp[:-1] == 0x27)
    return bool(len(at)) and bool((_KIND[cp[at + 1]] == 1).any())


def pretokens(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token: runs of one kind with a space before them, and white space by itself."""
    kind = _KIND[cp]
    n = len(cp)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    k = kind[starts]
    last = np.zeros(n + 1, bool)  # document ends
    last[off[1:]] = True
    white = np.flatnonzero((k == 0) & ~last[ends])  # white space with text after it: its last character stands apart
    tail = ends[white] - 1
    joins = cp[tail] == 0x20
    split = np.zeros(n, bool)
    split[starts] = True
    split[tail] = True
    nxt = ends[white[joins]]
    split[nxt] = False  # a space belongs to the run after it
    out = np.flatnonzero(split)
    return out, np.append(out[1:], n)
