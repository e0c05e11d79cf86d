import math
import re
from collections import Counter

import numpy as np

from sift.llm import max_sketch as ms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    docs = [(r[0], Counter(t), len(t)) for r in rows if (t := terms(r[1]))]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item, text in set(items):
        scored = []
        for doc_id, tf, size in docs:
            m = 75 + (25 * size * n) // length
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t, c in Counter(terms(text)).items() if tf[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def items_of(rows):
    texts = [r[1] for r in rows if r[1]]
    return [(i, " ".join(t.split()[:12]) or "x") for i, t in enumerate(texts[:40])] + [
        (100, None), (101, ""), (102, "unknownterm"), (103, "w1 w1 w1 W2"), (104, texts[5]), (104, texts[9]), (103, "w1 w1 w1 W2"), (None, "one"), (105, " ".join(texts))]


def test_equals_brute_force(spark, docs, rows):
    items = items_of(rows)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score long")
    got = ms.lexical_search(docs, q, 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items, 20)


def test_blocks_of_queries_and_string_ids(spark, docs, rows):
    items = items_of(rows)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = ms.lexical_search(docs.withColumn("doc_id", docs.doc_id.cast("string")), q, 3, query_block=16)
    want = brute([(None if r[0] is None else str(r[0]), r[1]) for r in rows], items, 3)
    assert sorted(map(tuple, got.collect()), key=str) == [tuple(w) for w in want]


def test_empty_tables(spark, docs, no_docs):
    q = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert ms.lexical_search(no_docs, q).count() == 0
    assert ms.lexical_search(docs, q.where("false")).count() == 0


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    vocab = tuple(f"t{i}" for i in range(3000))
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 300))) for _ in range(400)] + ["t1 " * 5000, "t2 " * 254]
    import pyarrow as pa
    from sift.llm import textkit as tk
    data, off = tk.text_bytes(pa.array(texts))
    doc, term, tf = ms._term_counts(data, off)
    df = dict(zip(*np.unique(term, return_counts=True)))
    entries = [(q, int(np.uint64(t).view(np.int64)), 1, int(df[t])) for q in range(20) for t in rng.choice(term, 15, replace=False)]
    block = ms.Block(entries, len(texts), int(tf.sum()))
    norm = block.norm(tk.per_doc(doc, len(texts), tf))
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    impacts = block.impacts([term[a:b].tobytes() for a, b in zip(ends, ends[1:])], [tf[a:b].astype(np.uint32).tobytes() for a, b in zip(ends, ends[1:])], norm)
    bound = block.bounds(ms.sketches(doc, term, tf, len(texts)), norm)
    exact = np.stack([block.scores(impacts, np.arange(len(texts)), q) for q in range(20)], axis=1)
    assert (bound >= exact).all()
    floor = np.sort(exact, axis=0)[-5]
    assert ((bound >= floor).sum(axis=0) < len(texts) // 4).all()  # most documents are never scored
