import hashlib
import random
import re

import numpy as np

from sift.llm import pii

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    o = [("email", *m.span()) for m in E.finditer(t)]
    o += [("ip", *m.span()) for m in I.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    o += [("card", *m.span()) for m in C.finditer(t) if 14 <= len(d(m.group())) <= 19 and pii.luhn(d(m.group()))]
    o += [("phone", *m.span()) for m in P.finditer(t) if 10 <= len(d(m.group())) <= 15]
    return sorted(o, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_plain_regular_expressions():
    rng = random.Random(3)
    parts = ["1", "2", "25", "0", "9", "4111111111111111", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "%", "x@y.z"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t) == brute(t), t


def test_message_passing_equals_enumeration_on_a_tree():
    rng = np.random.default_rng(1)
    unary = rng.normal(size=(4, 5))
    pairs, strength = np.array([[0, 1], [1, 2], [1, 3]]), np.array([1.0, 2.0, 0.5])
    p = np.zeros((4, 5))
    for x in np.ndindex(5, 5, 5, 5):
        w = np.exp(sum(unary[i, x[i]] for i in range(4)) + sum(s for (a, b), s in zip(pairs, strength) if x[a] == x[b]))
        for i in range(4):
            p[i, x[i]] += w
    assert np.allclose(pii.propagate(unary, pairs, strength), p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_strengths_maximise_the_pairwise_likelihood():
    nodes = np.array([50.0, 20, 5, 5, 20])
    pairs = np.array([[400.0, 600], [10, 300], [2, 900]])
    got = pii.fit_strengths(pairs, nodes)
    for kind, (differ, agree) in enumerate(pairs):
        share = nodes if kind == pii.CHAIN else nodes[1:]
        s = ((share / share.sum()) ** 2).sum()
        p = lambda w: s * np.exp(w) / (s * np.exp(w) + 1 - s)
        w = np.linspace(0, pii.STRENGTH_MOST, 8001)
        prior = pii.PRIOR_EDGES * p(pii.PRIOR[kind])
        like = (agree + prior) * np.log(p(w)) + (differ + pii.PRIOR_EDGES - prior) * np.log(1 - p(w))
        assert abs(got[kind] - w[like.argmax()]) < 2e-3
    assert np.allclose(pii.fit_strengths(np.zeros((3, 2)), nodes), pii.PRIOR)  # nothing seen: the prior
    assert pii.fit_strengths(np.array([[1e6, 1.0]] * 3), nodes).max() == 0.0  # never a reward for differing ends


def test_skip_edges_are_counted_between_base_matches_only():
    import pyarrow as pa
    t = "call +1 (988) 555-2485 or 1-988-555-2485, again +1 (988) 555-2485"
    rows = next(pii._counts([pa.RecordBatch.from_arrays([pa.array([t, None, ""])], ["text"])])).to_pylist()
    pairs = {(-2 - r["feature"], r["label"]): r["n"] for r in rows if r["feature"] < -1}
    assert pairs == {(pii.SAME, 1): 1}


def test_report_and_mask(docs, rows, no_docs):
    got = {}
    for r in pii.report(docs).collect():
        got.setdefault(r.doc_id, r)
    for r in rows:
        base = brute(r[1] or "")
        key = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[r[0]].base_sha256 == hashlib.sha256(key.encode()).hexdigest() or r[0] is None
        assert set(key.split(",")) <= set(got[r[0]].spans.split(",")) or r[0] is None
    assert got[410].n_added == 2  # the distant repeats of the address and the phone number
    assert "phone:" in got[410].spans and got[410].n_phone == 1
    m = pii.mask(docs)
    assert m.columns == docs.columns and m.count() == len(rows)
    text = m.where("doc_id = 410").first().text
    assert "555" not in text and text.count("[EMAIL]") == 2 and text.count("[PHONE]") == 2
    assert pii.report(no_docs).count() == 0
