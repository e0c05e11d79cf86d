import random
import re

from sift.llm import near_sets as ns

from .conftest import words


def brute(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def check(df, rows):
    got = ns.jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_equals_brute_force(docs, rows):
    check(docs, rows)


def test_long_lists_split_in_blocks_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ns, "LIST_BLOCK", 7)
    monkeypatch.setattr(ns, "HOT_LEAST", 4)
    rng = random.Random(11)
    base = words(rng, 90).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"q{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_rows_without_id_and_repeated_ids_link_like_others(spark):
    rng = random.Random(2)
    base = words(rng, 100, 10 ** 6).split()
    step = lambda n: " ".join(base[:-n] + [f"x{n}-{i}" for i in range(n)]) if n else " ".join(base)
    a, b, c = step(0), step(7), step(14)
    rows = [(1, a), (None, b), (2, c)]
    assert brute([(1, a), (2, c)]) == [(1, 97, 1), (2, 97, 2)]  # linked by the row between them alone
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    rows = [(9, a), (9, words(rng, 50)), (9, c), (3, b), (None, words(rng, 40)), (None, None), (4, a)] + [(None, c)] * 4
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    got = ns.jaccard_components(spark.createDataFrame([("y", a), ("x", b)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {("x", "x"), ("y", "x")}


def test_null_ids_and_empty_table(docs, no_docs):
    got = [r for r in ns.jaccard_components(docs).collect() if r.doc_id is None]
    assert len(got) == 2 and all(r.component_id is None for r in got)
    assert ns.jaccard_components(no_docs).count() == 0
