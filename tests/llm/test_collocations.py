import random
import re
from collections import Counter

import numpy as np

from sift.llm import collocations as co


def brute(rows, least, top, inside=80):
    freq, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    freq.setdefault(lang, Counter())[w[i:i + k]] += 1
    out = []
    for lang, f in freq.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s:s + m]] = max(longer[p[s:s + m]], a)
        found = []
        for p, a in cand.items():
            if 100 * longer[p] >= inside * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    stock = ["New York", "to be or not to be", "a a a a a", "rare pair here", "É tude", "x\ty  z"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(stock) if rng.random() < 0.3 else f"W{rng.randint(0, 12)}")
            if rng.random() < 0.15:
                words[-1] += rng.choice(".,;:!?\n\r\v\f")
        rows.append((i, " ".join(words), rng.choice(["en", "en", "de", None, "und"]), i))
    rows += [(1, None, "en", 0), (2, "", "en", 0), (3, "alone", "fr", 0), (None, "w1 w2 " * 5000, "en", 0), (4, "z" * 20000 + " " + "z" * 20000, "en", 0)]
    return rows + rows[:3]


def test_equals_brute_force(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(5)
    for least, top in ((4, 2000), (9, 7)):
        got = co.collocations(docs, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = brute([(r[1], r[2]) for r in rows], least, top)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_no_candidates(spark, docs, no_docs):
    assert co.collocations(no_docs).count() == 0
    assert co.collocations(docs, 10_000_000).count() == 0


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(co, "BURST", 20)
    rng = np.random.default_rng(1)
    for k in (2, 3, 4):
        trie, want, got = co.HatTrie(k), Counter(), Counter()
        for _ in range(30):
            words = rng.integers(0, 6, (200, k)).astype(np.uint64) + np.uint64(2**63)
            trie.add(words, np.ones(200, np.int64))
            want.update(map(tuple, words.tolist()))
            assert len(trie) == sum(len(c) for c in trie.child.values())
            if len(trie) > 100:
                run, n = trie.spill(50)
                assert len(trie) <= 50
                for p, c in zip(map(tuple, run.tolist()), n.tolist()):
                    got[p] += c
        run, n = trie.spill(0)
        for p, c in zip(map(tuple, run.tolist()), n.tolist()):
            got[p] += c
        assert got == want and len(trie) == 0


def test_rare_first_words_share_a_container():
    """A container holds a range of first words: as many first words as entries make few containers, frequent ones their own."""
    rng = np.random.default_rng(2)
    trie = co.HatTrie(2)
    rare = rng.integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    often = np.stack([np.full(50_000, 2**64 - 1, np.uint64), np.arange(50_000, dtype=np.uint64)], axis=1)
    for words in (rare, often, often):
        trie.add(words, np.full(len(words), 2))
    assert len(trie) == 100_000 and len(trie.child) < 100 and len(trie.child[2**64 - 1]) == 50_000
    words, n = trie.spill(0)
    want = Counter({**{tuple(w): 2 for w in rare.tolist()}, **{tuple(w): 4 for w in often.tolist()}})
    assert dict(zip(map(tuple, words.tolist()), n.tolist())) == want and len(trie) == 0


def test_small_limits_give_the_same(spark, monkeypatch):
    """Spills after every slice, and a filter so small that it lets most phrases through."""
    rows = phrase_rows()
    src = [(r[1], r[2] or "und") for r in rows]
    import pyarrow as pa
    monkeypatch.setattr(co, "LIMIT", 10)
    monkeypatch.setattr(co, "BURST", 5)
    monkeypatch.setattr(co, "MERGE", 7)

    class Full:
        value = np.full((1 << co.BITS) // 8, 255, np.uint8)

    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in src[i:i + 10]], pa.string()), pa.array([x for _, x in src[i:i + 10]])], ["text", "lang"])
               for i in range(0, len(src), 10)]
    runs = pa.Table.from_batches(co._count_phrases(Full, 2, (3, 4), 4)(batches)).sort_by("bucket")
    got = {}
    for b in co._merged(4)(runs.to_batches()):
        for lang, ids, f in zip(b["lang"].to_pylist(), b["ids"].to_pylist(), b["f"].to_pylist()):
            got.setdefault((lang, len(ids)), []).append(f)
    want = {}
    for lang, _, p, a, *_ in brute([(t, x) for t, x in src], 4, 10**9, 10**9):
        if len(p.split()) > 2:
            want.setdefault((lang, len(p.split())), []).append(a)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
