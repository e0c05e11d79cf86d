"""Operator 10: SentencePiece encoding and decoding by a weighted finite-state transducer.

A model compiles to three machines: the normaliser (white space to its symbol,
dummy prefix), the lexicon (a trie from characters to pieces, with byte
fallback for characters that no piece has) and a weight automaton.  For unigram
models the weight of a piece is its negative score.  For BPE models the automaton
remembers the last piece: an arc to the next piece weighs 0 if merging would
leave the two side by side, and infinity otherwise; the one path of finite weight is
the segmentation that merging gives.  Each input is composed with the machines
and its tropical-semiring shortest path is taken, position by position, for all
distinct stretches of a slice at once.  A stretch ends where no piece holds both
neighbouring characters, so shortest paths never cross it.

Defined results: null and empty text have no ids and decode to the empty text;
text with a literal U+2581 decodes to a space there; repeated rows are encoded
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .flow import prepare

SPACE = 0x2581
PART, OVERLAP, PART_CELLS = 512, 96, 2_000_000  # of a long stretch: letters of a part, of its margins, cells of a working table
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_PENALTY = 10.0
NEVER = np.int64(1) << 40


def read_model(path: str | None = None):
    """(pieces, scores, types, model type, add dummy prefix, unk id) of a model file."""
    import public_tokenizers as P
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path or P.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only identity normalisation is compiled")
    return ([p.piece for p in m.pieces], np.array([p.score for p in m.pieces]), np.array([p.type for p in m.pieces]),
            m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix, m.trainer_spec.unk_id)


def _sorted_lookup(table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    k = np.array(sorted(table), np.int64)
    return k, np.array([table[x] for x in k.tolist()], np.int64)


def _find(keys: np.ndarray, values: np.ndarray, x: np.ndarray, missing: int) -> np.ndarray:
    if len(keys) == 0:
        return np.full(len(x), missing, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], missing)


class Transducer:
    """Compiled model; ``encode`` and ``decode`` work on whole slices of texts."""

    def __init__(self, pieces: list[str], scores: np.ndarray, types: np.ndarray, kind: int, dummy: bool = True, unk: int = 0, most: int = 1_000_000):
        self.kind, self.dummy, self.most, self.unk = kind, dummy, most, unk
        normal = [i for i, t in enumerate(types.tolist()) if t in (NORMAL, USER) and pieces[i]]
        self.size = len(pieces)
        self.ids = {pieces[i]: i for i in normal}
        chars = sorted({c for i in normal for c in pieces[i]})
        self.n_chars = len(chars)
        self.code = np.full(0x110000, -1, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.single = np.array([self.ids.get(c, self.size + k) for k, c in enumerate(chars)], np.int64)  # ids from size on stand for a character without a piece
        self.char_of = chars
        at = {c: k for k, c in enumerate(chars)}
        self.together = np.zeros(len(chars) * len(chars), bool)
        trie: dict[int, int] = {}
        final, n_states = [-1], 1
        for i in normal:
            p = pieces[i]
            state = 0
            for a, b in zip(p, p[1:]):
                self.together[at[a] * len(chars) + at[b]] = True
            for c in p:
                key = state * len(chars) + at[c]
                nxt = trie.get(key)
                if nxt is None:
                    nxt = trie[key] = n_states
                    n_states += 1
                    final.append(-1)
                state = nxt
            final[state] = i
        for k, c in enumerate(chars):
            if c not in self.ids:
                state = trie.setdefault(k, n_states)
                if state == n_states:
                    n_states += 1
                    final.append(-1)
                final[state] = self.size + k
        self.trie = _sorted_lookup(trie)
        self.final = np.array(final, np.int64)
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        byte = {int(pieces[i][3:5], 16): i for i, t in enumerate(types.tolist()) if t == BYTE}
        self.byte = np.array([byte.get(b, unk) for b in range(256)], np.int64)
        self.has_bytes = len(byte) == 256
        if kind == BPE:
            self._merges(pieces, scores, normal)
        else:
            worst = float(scores[normal].min()) if normal else 0.0
            self.cost = np.concatenate([-scores.astype(float), np.full(len(chars), UNK_PENALTY - worst)])
        raw = [b"" if t in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace("▁", " ").encode()
               for p, t in zip(pieces, types.tolist())]
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._reset()

    # -- the weight automaton of a BPE model ------------------------------------------------

    def _merges(self, pieces: list[str], scores: np.ndarray, normal: list[int]) -> None:
        """Rank of every merge, the last merge of every piece, and which pieces merging ever makes."""
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-scores[i], i)))}
        total = self.size + self.n_chars
        self.born = np.full(total, -1, np.int64)
        self.left, self.right = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
        self.made = np.zeros(total, bool)
        self.made[self.single] = True
        merged: dict[int, int] = {}
        for i in normal:
            p = pieces[i]
            if len(p) == 1:
                continue
            for k in range(1, len(p)):
                a, b = self._id(p[:k]), self._id(p[k:])
                if a is not None and b is not None:
                    merged[a * total + b] = i
        self.score = scores
        for i in normal:
            if len(pieces[i]) > 1:
                parts, last = self._merge(pieces[i])
                if len(parts) == 1:
                    self.made[i], (self.left[i], self.right[i]) = True, last
                    self.born[i] = rank[i]
        # pieces of equal score (runs of white space) tie; ranks give them an order of their own, so such runs are merged directly
        counts: dict[float, int] = {}
        for i in normal:
            if len(pieces[i]) > 1:
                counts[float(scores[i])] = counts.get(float(scores[i]), 0) + 1
        tied = {c for i in normal if len(pieces[i]) > 1 and counts[float(scores[i])] > 1 for c in pieces[i]}
        self.tied = np.zeros(self.n_chars + 1, bool)
        self.tied_pairs = {pieces[i][k:k + 2] for i in normal if len(pieces[i]) > 1 and counts[float(scores[i])] > 1 for k in range(len(pieces[i]) - 1)}
        del tied
        self.total = total
        self.merge_key, self.merge_rank = _sorted_lookup({k: rank[i] for k, i in merged.items()})
        self.seen_key, self.seen_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def _id(self, s: str) -> int | None:
        i = self.ids.get(s)
        return int(self.single[self.code[ord(s)]]) if i is None and len(s) == 1 else i

    def _merge(self, s: str) -> tuple[list[int], tuple[int, int]]:
        """Merging by score, leftmost first among equals; the parts and the last merge made."""
        parts = list(s)
        last = (-1, -1)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > self.score[best]):
                    best, at = i, k
            if best is None:
                break
            last = (self._id(parts[at]), self._id(parts[at + 1]))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self._id(p) for p in parts], last

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would merging leave a and b apart?  Undo their merges, latest first; a merge across must never come before the one undone."""
        ok = self.made[a] & self.made[b]
        x, y, live = a.copy(), b.copy(), np.flatnonzero(ok)
        limit, strict = np.full(len(a), NEVER), np.ones(len(a), bool)
        while len(live):
            m = _find(self.merge_key, self.merge_rank, x[live] * self.total + y[live], NEVER)
            clash = np.where(strict[live], m < limit[live], m <= limit[live]) & (m < NEVER)
            ok[live[clash]] = False
            live = live[~clash]
            bx, by = self.born[x[live]], self.born[y[live]]
            live = live[(bx >= 0) | (by >= 0)]
            bx, by = self.born[x[live]], self.born[y[live]]
            undo_x = bx > by
            i, j = live[undo_x], live[~undo_x]
            limit[i], strict[i] = self.born[x[i]], True
            x[i] = self.right[x[i]]
            limit[j], strict[j] = self.born[y[j]], False
            y[j] = self.left[y[j]]
        return ok

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Arcs of the weight automaton, expanded on demand and remembered."""
        key = a * self.total + b
        u, back = np.unique(key, return_inverse=True)
        known = _find(self.seen_key, self.seen_ok, u, -1)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._side_by_side(u[new] // self.total, u[new] % self.total)
            if len(self.seen_key) > 4 * self.most:
                self.seen_key, self.seen_ok = np.zeros(0, np.int64), np.zeros(0, bool)
            k, v = np.concatenate([self.seen_key, u[new]]), np.concatenate([self.seen_ok, known[new].astype(bool)])
            by = np.argsort(k, kind="stable")
            self.seen_key, self.seen_ok = k[by], v[by]
        return known[back].astype(bool)

    # -- composition and shortest path ------------------------------------------------------

    def _paths(self, c: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Shortest paths of stretches (rows of character codes, padded with -1), as piece ids."""
        n, width = c.shape
        reach = min(self.longest, width)
        match = np.full((n, width, reach), -1, np.int64)  # piece over positions [i, i + k]
        for i in range(width):
            rows = np.flatnonzero(length > i)
            state = np.zeros(len(rows), np.int64)
            for k in range(min(reach, width - i)):
                own = c[rows, i + k].astype(np.int64)
                state = np.where(own >= 0, _find(*self.trie, state * self.n_chars + own, -1), -1)
                go = state >= 0
                rows, state = rows[go], state[go]
                if len(rows) == 0:
                    break
                match[rows, i, k] = self.final[state]
        last = np.full((n, width + 1), -1, np.int64)
        best = np.full((n, width + 1), np.inf)
        best[:, 0] = 0.0
        for e in range(1, width + 1):
            rows = np.flatnonzero(length >= e)
            k = np.arange(min(reach, e))
            p = match[rows[:, None], e - 1 - k, k]
            r, j = np.nonzero((p >= 0) & np.isfinite(best[rows[:, None], e - 1 - k]))
            row, piece, begin = rows[r], p[r, j], e - 1 - j
            if self.kind == BPE:
                before = last[row, begin]
                inner = np.flatnonzero(before >= 0)
                ok = self.made[piece]
                ok[inner] = self._allowed(before[inner], piece[inner])
                last[row[ok], e] = piece[ok]
                best[row[ok], e] = 0.0
            else:
                cost = best[row, begin] + self.cost[piece]
                by = np.lexsort((j, cost, row))
                first = by[np.unique(row[by], return_index=True)[1]]
                last[row[first], e] = piece[first]
                best[row[first], e] = cost[first]
        long = np.array([len(x) if x else 1 for x in self._names()], np.int64) if not hasattr(self, "_len") else self._len
        self._len = long
        out_rows, out_ids = [], []
        at = length.copy()
        rows = np.flatnonzero(at > 0)
        while len(rows):
            p = last[rows, at[rows]]
            out_rows.append(rows)
            out_ids.append(p)
            at[rows] -= long[p]
            rows = rows[at[rows] > 0]
        if not out_rows:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        r, p = np.concatenate(out_rows[::-1]), np.concatenate(out_ids[::-1])
        by = np.argsort(r, kind="stable")
        return p[by], np.bincount(r, minlength=n)

    def _long(self, c: np.ndarray) -> np.ndarray:
        """Shortest path of a long stretch, from the paths of overlapping parts side by side.

        A path is allowed if every two neighbouring pieces are.  So where two
        parts' paths pass the same piece at the same place, the first up to there
        and the second from there on are a path of both; without such a place in
        an overlap the stretch is taken whole.
        """
        start = np.arange(0, len(c), PART)
        begin, end = np.maximum(start - OVERLAP, 0), np.minimum(start + PART + OVERLAP, len(c))
        paths: list[np.ndarray] = []
        few = max(1, PART_CELLS // ((PART + 2 * OVERLAP) * self.longest))
        for a in range(0, len(start), few):
            own = slice(a, a + few)
            size = end[own] - begin[own]
            at = begin[own][:, None] + np.arange(size.max())
            part = np.where(np.arange(size.max()) < size[:, None], c[np.minimum(at, len(c) - 1)], -1)
            p, n = self._paths(part, size.copy())
            paths += np.split(p, np.cumsum(n)[:-1])
        out, done = [], 0  # the path up to place ``done``
        ends = [b + np.cumsum(self._len[p]) for b, p in zip(begin, paths)]
        for k in range(len(paths) - 1):
            meet = np.intersect1d(ends[k] * self.total_ids + paths[k], ends[k + 1] * self.total_ids + paths[k + 1], assume_unique=True)
            meet = meet[meet // self.total_ids > done]
            if len(meet) == 0:
                return self._paths(c[None, :], np.array([len(c)]))[0]
            cut = int(meet[len(meet) // 2] // self.total_ids)
            out.append(paths[k][(ends[k] > done) & (ends[k] <= cut)])
            done = cut
        out.append(paths[-1][ends[-1] > done])
        return np.concatenate(out)

    @property
    def total_ids(self) -> int:
        return self.size + self.n_chars + 1

    def _names(self) -> list[str]:
        names = [""] * (self.size + self.n_chars)
        for s, i in self.ids.items():
            names[i] = s
        for k, c in enumerate(self.char_of):
            names[self.size + k] = c
        return names

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _fallback(self, p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that stand for a character without a piece become its bytes (or the unknown id)."""
        odd = np.flatnonzero(p >= self.size)
        if len(odd) == 0:
            return p, size
        owner = np.repeat(np.arange(len(size)), size)
        parts = [[int(x)] if x < self.size else self._bytes(ord(self.char_of[x - self.size])) for x in p.tolist()]
        return np.array([y for x in parts for y in x], np.int64), np.bincount(owner, weights=[len(x) for x in parts], minlength=len(size)).astype(np.int64)

    def _bytes(self, cp: int) -> list[int]:
        return self.byte[list(chr(cp).encode("utf-8", "surrogatepass"))].tolist() if self.has_bytes else [self.unk]

    def _learn(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        """Shortest paths of new stretches, kept by their hash."""
        size = end - start
        codes = self.code[cp]
        outside = codes[start] < 0  # a character no piece has is a stretch of its own
        direct = np.zeros(len(start), bool)
        if self.kind == BPE and self.tied_pairs:
            blank = (cp[start] == SPACE) & (size > 1)
            direct[blank] = cp[np.minimum(start[blank] + 1, len(cp) - 1)] == SPACE
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(outside).tolist():
            ids = self._bytes(int(cp[start[k]]))
            found.append((np.array([k]), np.array(ids, np.int64), np.array([len(ids)])))
        for k in np.flatnonzero(direct & ~outside).tolist():
            ids = self._tied(cp[start[k]:end[k]])
            found.append((np.array([k]), *self._fallback(np.array(ids, np.int64), np.array([len(ids)]))))
        wide = ~outside & ~direct & (size > 4 * PART) & (self.kind == BPE)
        for k in np.flatnonzero(wide).tolist():
            p = self._long(codes[start[k]:end[k]].astype(np.int64))
            found.append((np.array([k]), *self._fallback(p, np.array([len(p)]))))
        rest = np.flatnonzero(~outside & ~direct & ~wide)
        rest = rest[np.argsort(size[rest], kind="stable")]
        a = 0
        while a < len(rest):
            w = int(size[rest[a]])
            w = w if w <= 8 else int(min(max(w + 4, w * 1.25), w + 64))
            b = int(np.searchsorted(size[rest], w, "right"))
            b = min(b, a + max(1, 400_000 // (w * min(w, self.longest))))
            own = rest[a:b]
            w = int(size[own].max())
            at = start[own][:, None] + np.arange(w)
            c = np.where(np.arange(w) < size[own][:, None], codes[np.minimum(at, len(cp) - 1)], -1)
            p, n = self._paths(c, size[own].copy())
            found.append((own, *self._fallback(p, n)))
            a = b
        which = np.concatenate([f[0] for f in found])
        count = np.concatenate([f[2] for f in found])
        begin = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *[f[1].astype(np.int32) for f in found]])
        k = np.concatenate([self.keys, keys[which]])
        by = np.argsort(k, kind="stable")
        self.keys, self.begin, self.count = k[by], np.concatenate([self.begin, begin])[by], np.concatenate([self.count, count])[by]

    def _tied(self, cp: np.ndarray) -> list[int]:
        """A run of white space before a word: the run's pieces tie in score, so its blanks are merged leftmost first."""
        s = "".join(map(chr, cp.tolist()))
        run = len(s) - len(s.lstrip("▁"))
        head, tail = s[:run - 1], s[run - 1:]
        if len(tail) == 1 or not self.together[self.code[SPACE] * self.n_chars + self.code[ord(tail[1])]]:
            head, tail = s[:run], s[run:]
        else:
            codes = self.code[[ord(c) for c in tail]]
            p, _ = self._paths(codes[None, :].astype(np.int64), np.array([len(tail)]))
            if p[0] == self.single[self.code[SPACE]]:  # the word leaves its blank to the run
                head, tail = s[:run], s[run:]
        out = self._blanks(len(head))
        if tail:
            codes = self.code[[ord(c) for c in tail]]
            out = out + self._paths(codes[None, :].astype(np.int64), np.array([len(tail)]))[0].tolist()
        return out

    def _blanks(self, n: int) -> list[int]:
        """Merged run of n blanks: equal parts pair up from the left, round after round."""
        if n <= 256:
            return self._merge("▁" * n)[0] if n else []
        most = max((len(p) for p in self.ids if set(p) == {"▁"}), default=1)
        k = (n - 128) // most
        return [self.ids["▁" * most]] * k + self._merge("▁" * (n - k * most))[0]

    def stretches(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches that no piece crosses."""
        c = self.code[cp].astype(np.int64)
        new = np.ones(len(cp), bool)
        both = (c[1:] >= 0) & (c[:-1] >= 0)
        new[1:] = ~(both & self.together[np.where(both, c[:-1] * self.n_chars + c[1:], 0)])
        new[off[:-1][off[:-1] < len(cp)]] = True
        start = np.flatnonzero(new)
        return start, np.append(start[1:], len(cp))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets)."""
        if len(self.keys) > self.most:
            self._reset()
        lead = "▁" if self.dummy else ""
        given = [lead + t if t else "" for t in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in given])])
        cp = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(cp) == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cp[cp == 0x20] = SPACE
        start, end = self.stretches(cp, off)
        data = cp.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].ravel()
        h = tk.span_hash(data, 3 * start, 3 * end)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            self._learn(cp, start[first[new]], end[first[new]], u[new])
            at = np.searchsorted(self.keys, u)
        at = at[back]
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.begin[at] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, off)]

    def decode_bytes(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets): the inverse machine, without the dummy blank."""
        ids = ids.astype(np.int64)
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.raw[np.repeat(self.raw_at[ids] - total[:-1], size) + np.arange(total[-1])]
        at = total[off]
        if self.dummy and len(out):
            first = at[:-1][(at[1:] > at[:-1])]
            drop = np.zeros(len(out), bool)
            drop[first[out[first] == 0x20]] = True
            at = at - np.concatenate([[0], np.cumsum(drop)])[at]
            out = out[~drop]
        return out, at

    def decode(self, ids: list[int]) -> str:
        out, _ = self.decode_bytes(np.array(ids, np.int64), np.array([0, len(ids)]))
        return out.tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(path: str | None = None) -> Transducer:
    return Transducer(*read_model(path))


def _encoded(path: str | None):
    def run(batches):
        machine = compiled(path)
        for batch in batches:
            data, off = tk.text_bytes(batch.column(1))
            texts = batch.column(1).to_pylist()
            for i, j in tk.slices(off):
                ids, at = machine.encode([t or "" for t in texts[i:j]])
                own, o = tk.cut(data, off, i, j)
                back, b = machine.decode_bytes(ids, at)
                same = [bool(b[r + 1] - b[r] == o[r + 1] - o[r] and (back[b[r]:b[r + 1]] == own[o[r]:o[r + 1]]).all()) for r in range(j - i)]
                crc = [zlib.crc32(ids[at[r]:at[r + 1]].astype("<u4").tobytes()) for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), tk.list_array(ids.astype(np.int32), at), pa.array(crc, pa.int64()), pa.array(same)],
                    ["doc_id", "n_ids", "ids", "ids_crc32", "round_trip"])
    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32, round_trip) for every document; ``round_trip``: decoding gives the text back."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_encoded(model), f"doc_id {kind}, n_ids long, ids array<int>, ids_crc32 long, round_trip boolean")


def _decoded(path: str | None):
    def run(batches):
        machine = compiled(path)
        for batch in batches:
            lists = batch.column(1)
            text = [None if x is None else machine.decode([i for i in x if i is not None]) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])
    return run


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) from id lists."""
    prepare(encoded.sparkSession)
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(_decoded(model), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
