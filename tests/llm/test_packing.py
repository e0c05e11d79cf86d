import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from sift.llm.packing import pack, plan


def test_plan_fills_every_place_once():
    rng = random.Random(1)
    for _ in range(50):
        size = rng.choice([16, 64, 2048])
        h = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 400)))
        seqs = defaultdict(list)
        for length, lo, hi, first, each, base in plan(h, size):
            for r in range(lo, hi):
                seqs[first + (r - lo) // each].append((base + (r - lo) % each * length, length))
        for parts in seqs.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= size
        assert sum(map(len, seqs.values())) == sum(h.values())
        # best-fit decreasing, one piece at a time, needs as many sequences
        free = []
        for n in sorted(h.elements(), reverse=True):
            fit = [f for f in free if f >= n]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - n)
            else:
                free.append(size - n)
        assert len(seqs) == len(free)


def test_pieces_equal_the_tokenizer_library(spark, docs, rows, no_docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    marked = [(700, "a <|endoftext|> b"), (701, "<|endoftext|>"), (702, "<|endoftext|><|endoftext|> it's <|endoftext|"), (703, "日本<|endoftext|>é " * 900)]
    rows = [*rows, *marked]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(marked, "doc_id long, text string"))
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        cuts = [0, n] if n <= 2048 else [0, *range(n % 2048 or 2048, n + 1, 2048)]
        want += [(r[0], p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = pack(docs).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert pack(no_docs).count() == 0
