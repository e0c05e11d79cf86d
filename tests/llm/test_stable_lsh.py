import numpy as np

from sift.llm import stable_lsh as lsh

INF = float("inf")


def make():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = [c + rng.normal(size=24) * 0.12 * np.linalg.norm(c) / 5 for c in centres for _ in range(12)]
    x += list(rng.normal(size=(60, 24)))
    rows = [(i, [float(np.float32(v)) for v in r], i % 3) for i, r in enumerate(x)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (501, rows[0][1], 0), (600, None, 1), (601, [], 1), (602, [0.0] * 24, 1),
             (603, [None] + [1.0] * 23, 1), (604, [INF] + [1.0] * 23, 1), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1)]
    return rows


def brute(rows, cosine=lsh.COSINE):
    """(id, links, component) by row; ids may be null or repeated."""
    good = [i for i, r in enumerate(rows) if r[1] and all(v is not None and abs(v) < INF for v in r[1]) and any(r[1])]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in good}
    near = {i: [j for j in good if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in good}
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in near:
            out[i] = (rows[i][0], 0, rows[i][0])
        elif i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = set(near[todo.pop()]) - group
                group |= new
                todo += new
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = (rows[j][0], len(near[j]), min(ids) if ids else None)
    return out


def run(spark, rows):
    got = lsh.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<float>").repartition(3))
    return [(r.vec_id, r.n_links, r.component_id) for r in got.collect()]


def test_recall_and_exactness(spark, monkeypatch):
    rows = make()
    want = {r[0]: r for r in brute(rows)}
    for block in (lsh.BLOCK, 5):
        monkeypatch.setattr(lsh, "BLOCK", block)
        got = run(spark, rows)
        assert all(n <= want[i][1] for i, n, _ in got)
        assert sum(n for _, n, _ in got) >= 0.9 * sum(want[i][1] for i, _, _ in got)
        by = {i: (n, c) for i, n, c in got}
        assert by[501][1] == 0 and by[500][0] >= 3 and by[606][1] == 605
        for k in (600, 601, 602, 603, 604):
            assert by[k] == (0, k)


def around(rng, base, cosine):
    """A vector at exactly that cosine to the unit vector ``base``."""
    r = rng.normal(size=len(base))
    r -= (r @ base) * base
    return cosine * base + np.sqrt(1 - cosine * cosine) * r / np.linalg.norm(r)


def test_recall_of_pairs_at_the_threshold(spark):
    rng, rows = np.random.default_rng(6), []
    for i in range(600):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        rows += [(2 * i, base.tolist()), (2 * i + 1, around(rng, base, rng.uniform(0.9005, 0.91)).tolist())]
    got = run(spark, rows)
    assert all(n <= 1 for _, n, _ in got)
    assert sum(n for _, n, _ in got) / 1200 >= 0.9


def test_repeated_and_null_ids_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=16)
    a /= np.linalg.norm(a)
    b = around(rng, a, 0.97)
    c = 2 * (b @ a) * b - a  # on the other side of b: within 0.97 of b, not within 0.9 of a
    near = [around(rng, a, 0.99).tolist() for _ in range(2)]
    rows = [(1, a.tolist()), (1, near[0]), (2, near[1])]
    assert sorted(run(spark, rows)) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    rows = [(1, a.tolist()), (None, b.tolist()), (2, c.tolist()), (None, [5.0] + [0.0] * 15), (None, None), (7, [0.0, 3.0] + [0.0] * 14), (7, [0.0, 6.0] + [0.0] * 14)]
    assert float(a @ c) < 0.9
    assert sorted(run(spark, rows), key=str) == sorted(brute(rows), key=str)
    assert (None, 2, 1) in run(spark, rows)


def test_shape_keeps_recall_at_every_size():
    for n in (0, 10, 10 ** 5, 10 ** 7, 10 ** 10):
        tables, projections = lsh.shape(n, 0.9, 0.94, lsh.WIDTH)
        near, far = lsh.collision(np.sqrt(0.2), lsh.WIDTH), lsh.collision(np.sqrt(2), lsh.WIDTH)
        assert 1 - (1 - near ** projections) ** tables >= 0.94
        assert n * far ** projections <= lsh.UNRELATED * 1.01


def test_string_ids_and_empty(spark):
    got = lsh.near_duplicates(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.001])], "vec_id string, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [("a", 1, "a", True), ("b", 1, "a", False)]
    assert lsh.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
