import random
import re

import corpus_pipeline as cp

from .conftest import words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, docs, rows):
    d = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/t-{abs(hash(name))}-{id(out)}"
        out.write.parquet(path)
        d = spark.read.parquet(path)
    ids = [r.doc_id for r in d.collect()]
    assert 101 not in ids and ids.count(0) <= 1


def test_one_document_of_each_group_stays(spark, docs):
    out = [r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert out.count(100) == 1 and not set(range(101, 112)) & set(out) and out.count(0) == 1
    assert {400, 401, 402} <= set(out) and (403 in out) != (404 in out)


def test_run_packs_what_the_stages_kept(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < got.select("doc_id").distinct().count() < 200


def test_empty_documents(spark, no_docs):
    for name, stage in cp.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name


def near_brute(rows):
    """(doc_id, text) of the rows that stay, from plain sets of five words and similarities of 0.8 or more."""
    nodes = sorted({tuple(r[:2]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    sets = []
    for _, text in nodes:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(nodes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    one = [nodes[i] for i in range(len(nodes)) if sets[i] and find(i) == i]
    bare = {nodes[i] for i in range(len(nodes)) if not sets[i]}
    return one + [tuple(r[:2]) for r in rows if tuple(r[:2]) in bare]


def near_check(spark, rows):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, df, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, near_brute(rows)))
    return got


def test_near_copies_of_five_words_and_80_percent_go(spark, rows):
    rng = random.Random(3)
    own = [(1000 + i, words(rng, 400, 10 ** 6)) for i in range(3)]
    own += [(1010 + i, own[0][1] + " " + words(rng, n, 10 ** 6)) for i, n in enumerate((80, 96, 104))]
    own += [(1020 + i, " ".join(own[1][1].split()[n:])) for i, n in enumerate((70, 78))]
    got = {r[0] for r in near_check(spark, rows + own)}
    assert not {1010, 1011, 1020, 1021} & got
    assert {1000, 1001, 1002, 1012} <= got


def test_rows_with_one_id_and_different_texts_are_documents_of_their_own(spark):
    rng = random.Random(4)
    a, b, c, d = (words(rng, 60, 10 ** 6) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (3, b + " x"), (9, c), (9, d), (12, a), (None, a), (None, a), (20, None), (20, ""), (20, " ")]
    got = near_check(spark, rows)
    assert (5, a) in got and (9, d) in got and (5, b) not in got and (12, a) not in got
    own = spark.createDataFrame([(9, c), (9, c + " y")], "doc_id long, text string")
    assert cp.near_duplicates(spark, own, SF).count() == 1
    own = spark.createDataFrame([(None, c, "x"), (None, c, "x"), (None, c + " y", "z"), (None, None, "x")], "doc_id long, text string, node string")
    assert sorted((r.node, r.text is None) for r in cp.near_duplicates(spark, own, SF).collect()) in ([("x", False), ("x", True)], [("x", True), ("z", False)])


def test_run_equals_a_plain_chain_on_the_classifiers_documents(spark):
    """Near copies and repeated bytes by plain Python, masked, then cut by the tokenizer library."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in cp.quality(spark, docs, SF).collect()]
    near = near_brute(kept)
    raw = [(i, (x or "").encode()) for i, x in near]
    seen = Counter(t[i:i + 200] for _, t in raw for i in range(len(t) - 199))
    rest = []
    for doc, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        rest.append((doc, bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")))
    masked = cp.personal_data(spark, spark.createDataFrame(rest, "doc_id long, text string"), SF).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in masked:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        cuts = [0, n] if n <= 2048 else [0, *range(n % 2048 or 2048, n + 1, 2048)]
        want += [(r.doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in cp.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and 0 < len(near) <= len(kept)
