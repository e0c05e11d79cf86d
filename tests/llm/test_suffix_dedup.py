import hashlib
from collections import Counter

import numpy as np

from sift.llm import suffix_dedup as sd


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def check(df, rows):
    want = brute([(r[1] or "").encode() for r in rows], sd.LENGTH)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup_report(df).collect()]
    assert sorted(map(str, got)) == sorted(str((r[0], *w)) for r, w in zip(rows, want))


def test_equals_brute_force(docs, rows):
    check(docs, rows)


def test_hot_anchors_split_by_window(docs, rows, monkeypatch):
    monkeypatch.setattr(sd, "HOT_CONTEXTS", 1)
    check(docs, rows)


def test_interval_expansion_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        t = rng.integers(0, 2, 400).astype(np.uint8)
        t[200:260] = t[20:80]
        valid = rng.random(400) < 0.9
        valid[-31:] = False
        seen = Counter(t[i:i + 32].tobytes() for i in np.flatnonzero(valid))
        want = np.array([valid[i] and seen[t[i:i + 32].tobytes()] > 1 for i in range(400)])
        assert (sd.repeated_starts(t, valid, 32) == want).all()


def test_backward_extension_up_to_the_last_byte():
    """Small alphabets with zero bytes, depths of 2 to 5 symbols, and a repeat that ends the text."""
    rng = np.random.default_rng(1)
    for k in range(200):
        length, n = (16, 24, 32, 40)[k % 4], int(rng.integers(100, 600))
        t = rng.integers(0, 1 + k % 3, n).astype(np.uint8)
        t[n - 45:] = t[:45]
        valid = rng.random(n) < 0.95
        valid[n - length + 1:] = False
        valid[n - length] = True
        seen = Counter(t[i:i + length].tobytes() for i in np.flatnonzero(valid))
        want = np.array([valid[i] and seen[t[i:i + length].tobytes()] > 1 for i in range(n)])
        assert (sd.repeated_starts(t, valid, length) == want).all(), (n, length)


def test_text_stage(docs, rows, no_docs):
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert {r.text for r in out.where("doc_id BETWEEN 100 AND 111").collect()} == {""}
    assert out.where("doc_id = 400").first().text is None
    assert sd.dedup_report(no_docs).count() == 0


def test_rows_without_id_or_with_one_id_are_spread_by_text(spark, monkeypatch):
    """No array holds more than one text's spans or lent contexts, and equal rows lend once."""
    rng = np.random.default_rng(9)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = text(300)
    rows = [(None if i % 2 else 7, text(50 + i) + shared + text(40)) for i in range(60)] + [(None, text(260))] * 9 + [(None, None), (-1, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = sd.repeated_spans(df).collect()
    assert len(spans) == 62 and max(len(r.spans) for r in spans) <= 300
    lent = []
    keep = sd.Stage.keep

    def watch(self, frame, part):
        out = keep(self, frame, part)
        if part == "pieces":
            lent.append((out.count(), out.select("anchor", "context").distinct().count()))
        return out
    monkeypatch.setattr(sd.Stage, "keep", watch)
    check(df, rows)
    assert lent[0][0] == lent[0][1]
