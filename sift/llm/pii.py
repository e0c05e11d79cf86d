"""Operator 3: personal data by a skip-chain conditional random field.

Nodes are the base matches of a document (clamped to their kind) and loose
candidates: number chains and address-like tokens that no base rule accepts.
Unary potentials are log-odds of a node's form, counted over the whole corpus
with the base matches as labels.  Neighbouring nodes share chain potentials;
nodes with the same normalised form (or the same last digits or mailbox), however
distant, share skip potentials.  Their strengths are fitted to the corpus: the
maximum of the pairwise likelihood, given how often the ends of such edges agree
and how often they would by chance, with ``PRIOR_EDGES`` edges of prior strength.
Skip edges are counted between base matches only, since the label of a candidate
that repeats one is what is looked for.  Loopy sum-product
message passing runs over each document; a candidate whose most likely label is
an entity becomes a span.  Base spans always stay.

Defined results: null text is empty (no spans, digest of the empty string);
repeated rows are judged alike; the order of rows does not matter; an empty
table gives an empty result; extra columns are ignored, or kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .flow import prepare

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
CHAIN, SIMILAR, SAME = range(3)  # kinds of edges
PRIOR, PRIOR_EDGES, STRENGTH_MOST = np.array([0.2, 3.0, 6.0]), 100.0, 8.0
UNARY_MOST, ROUNDS, DAMP = 3.0, 30, 0.5

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(](?:at|AT)[\])] ?|@)[A-Za-z0-9-]{1,64}+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,64}+)*")
_OFTEN = re.compile(r"[0-9@\[(]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start and then kind."""
    if not _ANY.search(text):
        return []
    out = []
    done = 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append(("email", s, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Candidates outside the base matches."""
    if not _OFTEN.search(text):
        return []
    found = [m.span() for p in (_NUMBER, _ADDRESS) for m in p.finditer(text)] if _ANY.search(text) or "at" in text.lower() else []
    out, taken, k = [], sorted((s, e) for _, s, e in base), 0
    last = -1
    for s, e in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= last and not (k < len(taken) and taken[k][0] < e):
            out.append((s, e))
            last = e
    return out


def form(s: str) -> list[int]:
    """Feature numbers of a node: digits, groups, sign, mailbox, check sum."""
    d = _digits(s)
    return [min(len(d), 24), 25 + min(len(re.findall(r"[0-9]+", s)), 6), 32 + ("+" in s), 34 + ("@" in s) + 2 * ("at" in s.lower()),
            38 + (len(d) >= 14 and luhn(d)), 40 + min(s.count("."), 4)]


N_FORMS = 45


def _counts(batches):
    """Summed over each batch: (feature, label, n) with feature -1 for nodes, and (-2 - kind of edge, 1 if its ends agree, n)."""
    for batch in batches:
        n = np.zeros((N_FORMS + 1, len(LABELS)), np.int64)
        pairs = np.zeros((len(PRIOR), 2), np.int64)
        for t in batch.column(0).to_pylist():
            if t:
                nodes = _nodes(t, (base := base_spans(t)), loose_spans(t, base))
                for label, s, e in nodes:
                    n[[-1, *form(t[s:e])], label] += 1
                for (i, j), kind in (_edges(t, nodes) if len(nodes) > 1 else {}).items():
                    if kind == CHAIN or (nodes[i][0] and nodes[j][0]):
                        pairs[kind, int(nodes[i][0] == nodes[j][0])] += 1
        f, y = np.nonzero(n)
        k, z = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.where(f == N_FORMS, -1, f), -2 - k])), pa.array(np.concatenate([y, z])),
                                          pa.array(np.concatenate([n[f, y], pairs[k, z]]))], ["feature", "label", "n"])


def fit_strengths(pairs: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Strength of each kind of edge from its (differing, agreeing) ends and the nodes of every label.

    Ends agree with probability S e^w / (S e^w + 1 - S), S the chance that two
    independent nodes agree, so the likelihood is largest where the log-odds of
    agreeing exceed those of S by w.  The prior adds edges that agree as ``PRIOR`` has it.
    """
    out = np.empty(len(PRIOR))
    for kind, (differ, agree) in enumerate(pairs):
        share = nodes if kind == CHAIN else nodes[1:]
        chance = float(np.clip(((share / share.sum()) ** 2).sum(), 1e-6, 1 - 1e-6))
        chance_odds = math.log(chance / (1 - chance))
        prior = 1 / (1 + math.exp(-(chance_odds + PRIOR[kind])))
        odds = math.log((agree + PRIOR_EDGES * prior) / (differ + PRIOR_EDGES * (1 - prior)))
        out[kind] = min(max(odds - chance_odds, 0.0), STRENGTH_MOST)
    return out


Weights = tuple[np.ndarray, np.ndarray]


def learn(docs: DataFrame, text_col: str = "text") -> Weights:
    """Tables of fixed size: log-odds against ``none`` of every (feature, label), of the labels in the last row; strengths of the edges."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_counts, "feature long, label long, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    n = np.full((N_FORMS + 1, len(LABELS)), 0.5)
    pairs = np.zeros((len(PRIOR), 2))
    for r in rows:
        if r["feature"] >= -1:
            n[r["feature"], r["label"]] += r["n"]
        else:
            pairs[-2 - r["feature"], r["label"]] += r["n"]
    share = n / n[-1]
    out = np.log(share / share[:, :1])
    out[-1] = np.log(n[-1] / n[-1, 0])
    return out, fit_strengths(pairs, n[-1])


def _nodes(text: str, base: list[tuple[str, int, int]], loose: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end) of the base matches and of the candidates (label 0), in order."""
    return sorted([(LABELS.index(k), s, e) for k, s, e in base] + [(0, s, e) for s, e in loose], key=lambda x: (x[1], x[0]))


def _edges(text: str, nodes: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Chain and skip edges with their kinds; equal forms are chained in order, so a document has O(nodes) edges."""
    edges: dict[tuple[int, int], int] = {}
    same, like = defaultdict(list), defaultdict(list)
    for k, (_, s, e) in enumerate(nodes):
        w = text[s:e]
        d = _digits(w)
        box = re.split(r"@| ?[\[(](?:at|AT)[\])]", w)
        if len(box) > 1:
            same["@" + re.sub(r" ?[\[(]dot[\])] ?", ".", "@".join(b.strip() for b in box).lower())].append(k)
            like["@" + box[0].strip().lower()].append(k)
        elif len(d) >= 7:
            same[d].append(k)
            like[d[-7:]].append(k)
        if k and s - nodes[k - 1][2] <= 100:
            edges[(k - 1, k)] = CHAIN
    for groups, kind in ((like, SIMILAR), (same, SAME)):
        for g in groups.values():
            anchor = next((k for k in g if nodes[k][0]), g[0])
            for a, b in [*zip(g, g[1:]), *((min(anchor, k), max(anchor, k)) for k in g if k != anchor)]:
                edges[(a, b)] = max(kind, edges.get((a, b), CHAIN))
    return edges


def propagate(unary: np.ndarray, pairs: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Loopy sum-product marginals (nodes x labels); an edge favours equal labels by exp(strength)."""
    n, k = unary.shape
    if len(pairs) == 0:
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    src = np.concatenate([pairs[:, 0], pairs[:, 1]])
    dst = np.concatenate([pairs[:, 1], pairs[:, 0]])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    gain = np.expm1(np.concatenate([strength, strength]))[:, None]
    m = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, m)
        into = belief[src] - m[back]
        p = np.exp(into - into.max(axis=1, keepdims=True))
        out = np.log(p.sum(axis=1, keepdims=True) + gain * p)
        out -= out.max(axis=1, keepdims=True)
        new = DAMP * m + (1 - DAMP) * out
        if np.abs(new - m).max() < 1e-4:
            m = new
            break
        m = new
    belief = unary.copy()
    np.add.at(belief, dst, m)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_spans(text: str, weights: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    loose = loose_spans(text, base)
    if not loose:
        return base, base
    forms, strengths = weights
    nodes = _nodes(text, base, loose)
    unary = np.empty((len(nodes), len(LABELS)))
    for r, (label, s, e) in enumerate(nodes):
        unary[r] = np.clip(forms[form(text[s:e])].sum(axis=0) + forms[-1], -UNARY_MOST, UNARY_MOST)
        unary[r, 0] = 0.0
        if label:
            unary[r] = -50.0
            unary[r, label] = 0.0
    edges = _edges(text, nodes)
    p = propagate(unary, np.array(list(edges), np.int64).reshape(-1, 2), strengths[np.array(list(edges.values()), np.int64)])
    best = p.argmax(axis=1)
    added = [(LABELS[best[r]], s, e) for r, (label, s, e) in enumerate(nodes) if label == 0 and best[r] and p[r, best[r]] > 0.5]
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _report(weights: Weights):
    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, every = find_spans(t or "", weights)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return run


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts by kind, base_sha256, spans, n_added) for every document."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_report(learn(src)), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones by the first one's."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _masker(weights: Weights, at: int):
    def run(batches):
        for batch in batches:
            new = [None if t is None else masked(t, find_spans(t, weights)[1]) for t in batch.column(at).to_pylist()]
            cols = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)
    return run


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text masked; other columns as they are."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    own = docs.select(*[(F.col(c).cast("string") if c == text_col else F.col(c)).alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    out = own.mapInArrow(_masker(learn(docs, text_col), at), T.StructType(own.schema.fields))
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
