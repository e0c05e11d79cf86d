import itertools
import random

import numpy as np
import sentencepiece

from sift.llm import wfst


def test_equals_the_library():
    import public_tokenizers as P
    m, sp = wfst.compiled(), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    parts = ["the", "ing", "a", "b", " ", "  ", "e", "r", "in", "on", "é", "字", "\n", ".", "1", "tion", "   ", "𝔘", "▁"]
    texts = ["", " ", "a  b", " a", "x" * 60, " " * 300, "a" + " " * 33 + "é", "日本語 x", "\t a", "😀 é"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ids, at = m.encode(texts)
    for i, t in enumerate(texts):
        own = ids[at[i]:at[i + 1]].tolist()
        assert own == sp.encode(t), t
        assert m.decode(own) == sp.decode(own) == t.replace("▁", " ")


def test_long_stretches_equal_the_library():
    """Parts side by side, joined where their paths meet: letters without a blank, and repeats whose paths meet late."""
    import time

    import public_tokenizers as P
    m, sp = wfst.compiled(), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(rng.choice(letters) for _ in range(9000)), "a" * 7001, "ab" * 3000, "".join(rng.choice("the ing").replace(" ", "") or "n" for _ in range(5000)),
             "if(a){return" * 400, "é字x" * 1500, "x" + "".join(rng.choice(letters) for _ in range(2100)) + " tail"]
    ids, at = m.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == sp.encode(t), t[:40]
    began = time.time()
    m.encode(["".join(rng.choice(letters) for _ in range(200_000))])
    assert time.time() - began < 30


def test_unigram_shortest_path_equals_enumeration():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aab", "abb"]
    scores = np.array([0, -3.0, -2.1, -2.3, -3.1, -3.7, -4.9, -5.05, -5.6])
    types = np.array([2] + [1] * 8)
    m = wfst.Transducer(pieces, scores, types, wfst.UNIGRAM)
    index = {p: i for i, p in enumerate(pieces)}

    def best(s):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            p = [s[a:b] for a, b in zip(at, at[1:])]
            if all(x in index for x in p):
                found.append((-sum(scores[index[x]] for x in p), [index[x] for x in p]))
        return min(found)
    for n in range(1, 8):
        for t in itertools.product("ab", repeat=n):
            text = "".join(t)
            ids, _ = m.encode([text])
            assert abs(-scores[ids].sum() - best("▁" + text)[0]) < 1e-9


def test_documents(docs, rows, no_docs):
    enc = wfst.encode_documents(docs)
    got = enc.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    back = {(r.doc_id, r.text) for r in wfst.decode_documents(enc).collect()}
    assert back == {(r[0], r[1] or "") for r in rows}
    assert wfst.encode_documents(no_docs).count() == 0
