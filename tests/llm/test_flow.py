import random

from pyspark.sql import functions as F

from sift.llm.flow import Stage, components, join_stats, rank_within


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(700, 701), (701, 702), (702, 700), (9, 9)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {(v, find(v)) for v in up if find(v) != v}
    st = Stage(spark, "t")
    got = components(st, spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b")
    assert {(r.v, r.m) for r in got.collect()} == want
    assert components(Stage(spark, "t"), spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ranks_are_gapless_and_distributed(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 2).alias("o"))
    rows = rank_within(df, ["k"], ["o"], "place", 8).collect()
    for k in range(3):
        own = sorted(r.place for r in rows if r.k == k)
        assert own == list(range(len(own)))


def test_statistics_join_keeps_every_row(spark, monkeypatch):
    from sift.llm import flow
    monkeypatch.setattr(flow, "HEAVY", 4)
    df = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i % 20}", i) for i in range(40)] + [("unseen", 0)], "k string, v long")
    stats = df.where("k <> 'unseen'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_stats(df, stats, "k", "n", 100).collect()
    assert len(got) == 101 and {r.n for r in got if r.k == "hot"} == {60} and [r.n for r in got if r.k == "unseen"] == [None]
