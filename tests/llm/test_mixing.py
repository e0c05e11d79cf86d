import heapq
import math
from collections import Counter
from hashlib import md5

from sift.llm import mixing


def draw(*parts):
    return int(md5("|".join(["13", *["null" if p is None else str(p) for p in parts]]).encode()).hexdigest()[:15], 16)


def seats_of(votes, seats):
    """Sainte-Lague, one seat after the other."""
    heap = [(-v, i, 1) for i, v in votes.items() if v > 0]
    heapq.heapify(heap)
    out = Counter()
    for _ in range(seats if heap else 0):
        _, i, j = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * j + 1), i, j + 1))
    return out


def brute(rows, block, shard_words):
    size = lambda t: len([w for w in (t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w])
    docs = [(s, d, size(t)) for d, t, s in rows]
    total = Counter()
    for s, _, n in docs:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, goal = set(), sum(total.values()) * 150 / 100
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            break
        level = (goal - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if 2 * total[s] <= weight[s] * level}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * total[s] if s in capped else weight[s] * level for s in order}
    quota = seats_of({i: target[s] for i, s in enumerate(order)}, round(sum(target.values()) / block))
    out = []
    for i, s in enumerate(order):
        shards = max(1, math.ceil(total[s] / shard_words))
        cells = {}
        for _, d, n in [x for x in docs if x[0] == s]:
            if n == 0:
                out.append((d, 0, s, total[s], target[s], 0))
            else:
                cells.setdefault(draw(d, n) % shards, []).append((draw(d, n), d is None, d or 0, n, d))
        own = seats_of({c: float(sum(x[3] for x in v)) for c, v in cells.items()}, quota[i])
        for c, v in cells.items():
            words = [j for j, x in enumerate(sorted(v, key=lambda x: x[:4])) for _ in range(x[3])]
            nb = math.ceil(len(words) / block)
            q = min(own[c], 2 * nb)
            shift, taken = draw(i, c) % nb, Counter()
            for b in range(nb):
                again = (b + 1 + shift) * (q % nb) // nb - (b + shift) * (q % nb) // nb
                for j in words[b * block:(b + 1) * block]:
                    taken[j] += q // nb + again
            out += [(x[4], x[3], s, total[s], target[s], taken[j]) for j, x in enumerate(sorted(v, key=lambda x: x[:4]))]
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_equals_brute_force(spark, docs, rows):
    for block, shard in ((8, 1 << 16), (5, 300), (1, 50)):
        got = [tuple(r) for r in mixing.mix(docs, block=block, shard_words=shard).collect()]
        want = brute([(r[0], r[1], r[3]) for r in rows], block, shard)
        assert [(*r[:4], round(r[4], 6), r[5]) for r in sorted(got, key=key)] == [(*r[:4], round(r[4], 6), r[5]) for r in sorted(want, key=key)]
        assert all(0 <= r[5] <= 2 * r[1] for r in got)


def test_taken_words_come_near_the_targets_and_repeat(spark, docs):
    got = mixing.mix(docs)
    by, target = Counter(), {}
    for r in got.collect():
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - t) <= 16 + 0.01 * t for s, t in target.items())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_one_row_repeated_often_is_cut_into_arrays(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(1, "a b c", "s")] * 40 + [(None, "x y z", "s")] * 9 + [(3, "", "s")] * 8 + [(4, "d " * 30, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in mixing.mix(docs, shard_words=20).collect()), key=key)
    assert got == sorted(brute(rows, 8, 20), key=key)


def test_no_words_and_empty(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mix(docs).collect())) == [(1, 0, "a", 0, 0.0, 0), (2, 0, None, 0, 0.0, 0)]


def test_main_path_has_no_python(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
