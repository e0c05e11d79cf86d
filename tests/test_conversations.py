"""Conversation operators on a hand-made session with a system turn and a gap in alternation."""
from sift.operators import conversations as C

ROWS = [(7, 0, "system", "be brief"), (7, 1, "user", "Hello store people"), (7, 2, "assistant", "Hi."),
        (7, 3, "user", "inventory inventory question retail"), (7, 4, "user", "again?"),
        (7, 5, "assistant", "Yes. Sure thing."), (8, 0, "user", "lonely")]


def turns(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")


def test_exchanges(spark):
    ex = sorted((r.conv_id, r.q_turn, r.exchange_no) for r in C.exchanges(turns(spark)).collect())
    assert ex == [(7, 1, 0), (7, 4, 1)]


def test_tail_and_slice(spark):
    t = C.tail_history(turns(spark), 2).collect()
    assert sorted((r.conv_id, r.turn) for r in t) == [(7, 4), (7, 5), (8, 0)]
    h = {(r.conv_id, r.turn): r.history_text for r in C.history_slice(turns(spark), 2).collect()}
    assert h[(7, 4)] == "assistant: Hi.\nuser: inventory inventory question retail"
    assert h[(8, 0)] == ""


def test_budget(spark):
    b = {r.turn: (r.newer_tokens, r.kept) for r in C.budget_memory(turns(spark), 5).filter("conv_id = 7").collect()}
    assert b[5] == (3, True) and b[4] == (4, True) and b[3] == (8, False)


def test_insights(spark):
    ins = {r.conv_id: (r.total_exchanges, r.common_topics) for r in C.session_insights(turns(spark)).collect()}
    assert ins[7] == (2, "inventory, hello, store")
    assert ins[8] == (0, "lonely")     # one message: 0 exchanges, still has topics


# ------------------------------------------------------------------ null, repeated and sparse turns

SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows():
    import random
    rng = random.Random(3)
    rows = [(1, None, "user", "no turn at all"), (1, 5, "user", "five. And more"), (1, 5, "assistant", "five too."), (1, 4, "user", "four here"), (1, None, "assistant", "late")]
    rows += [(2, 1000 * i, "user" if i % 2 == 0 else "assistant", f"m{i} word") for i in range(10)]
    rows += [(3, rng.choice([-(2 ** 40), -70_000, -3, 0, 65_535, 65_536, 2 ** 33 + i, 2 ** 62]), rng.choice(["user", "assistant"]), f"t{i}") for i in range(60)]
    rows += [(4, 7, "user", "same"), (4, 7, "user", "same"), (4, 7, "user", None), (4, 7, None, "same"), (None, 1, "user", "no conversation")]
    return rows


def ordered(spark, rows):
    """Messages of each conversation in the defined order, by plain sorting of Spark's hash."""
    from pyspark.sql import functions as F
    h = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + SCHEMA).orderBy("i").select(F.xxhash64("role", "text")).collect()]
    by = {}
    for r, x in zip(rows, h):
        by.setdefault(r[0], []).append((r[1] is None, r[1] or 0 if r[1] is not None else x, x, r[2] or "", r[3] or "", r))
    return {c: [m[-1] for m in sorted(v, key=lambda m: m[:5])] for c, v in by.items()}


def test_positions_of_null_repeated_and_sparse_turns(spark):
    rows = odd_rows()
    got = {}
    for r in C.positions(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got.setdefault(r.conv_id, {})[r._pos] = (r.conv_id, r.turn, r.role, r.text)
    want = ordered(spark, rows)
    assert all([got[c][i] for i in range(len(v))] == v for c, v in want.items() if c not in (None, 4))
    assert sorted(got[4]) == [0, 1, 2, 3]


def test_no_message_is_lost_and_pages_hold_a_hundred(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    b = C.budget_memory(df, 1000).where("conv_id IS NOT NULL")
    assert b.count() == len(rows) - 1
    five = b.where("conv_id = 1").orderBy("position").collect()
    assert [r.turn for r in five] == [4, 5, 5, None, None] and five[0].newer_tokens == sum(r.tokens for r in five)
    t = C.transcript(df.where("conv_id = 2")).collect()
    assert len(t) == 1 and t[0].page == 0 and t[0].transcript.count("\n") == 9
    many = spark.createDataFrame([(9, 10 ** 6 * i, "user", f"m{i}") for i in range(250)], SCHEMA)
    assert sorted((r.page, r.transcript.count("user: ")) for r in C.transcript(many).collect()) == [(0, 100), (1, 100), (2, 50)]
    assert sorted(r.page for r in C.overflow_digest(C.budget_memory(many, 20)).collect()) == [0, 1, 2]


def test_exchanges_and_slices_over_gaps(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    ex = sorted((r.q_turn, r.exchange_no) for r in C.exchanges(df).where("conv_id = 2").collect())
    assert ex == [(2000 * i, i) for i in range(5)]
    h = {r.turn: r.history_size for r in C.history_slice(df, 6).where("conv_id = 2").collect()}
    assert h == {0: 0, 2000: 2, 4000: 4, 6000: 6, 8000: 6}
    assert C.history_slice(df, 6).where("conv_id = 1 AND turn IS NULL").count() == 1
    tail = C.tail_history(df, 2).where("conv_id = 1").collect()
    assert {r.turn for r in tail} == {None}
    stamped = df.where("conv_id = 2").selectExpr("conv_id", "timestamp_seconds(turn) AS turn", "role", "text")
    assert C.exchanges(stamped).count() == 5


def test_ranked_digest_prefers_the_sentence_that_others_share(spark):
    rows = [(1, 0, "user", "Apples are red. Pears are green."), (1, 1, "assistant", "Red apples are sweet! Unrelated words stand alone here."),
            (1, 2, "user", "Are sweet apples red? "), (1, 3, "user", None), (1, 4, "user", "kept")]
    b = C.budget_memory(spark.createDataFrame(rows, SCHEMA), 1)
    got = C.ranked_digest(b, keep=2).collect()
    assert [(r.page, r.unit) for r in got] == [(0, 0)] and got[0].summary.split("\n") == ["Apples are red.", "Red apples are sweet!"]
    assert len(C.ranked_digest(b, keep=1, unit=2).collect()) == 3  # five sentences in units of two


def test_sketches_of_parts_combine(spark):
    import tempfile

    from pyspark.sql import functions as F

    from sift.operators import sketches as S
    path = tempfile.mkdtemp(prefix="sift-sk-")
    ev = spark.range(40_000).select(F.timestamp_seconds(F.col("id") % 36_000).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"),
                                    F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("value"))
    for part in (0, 1):
        S.write_latency_sketches(ev.where(F.pmod(F.xxhash64("value"), F.lit(2)) == part), f"{path}/l")
    p = S.latency_from_sketches(spark.read.parquet(f"{path}/l"))
    for r in ev.join(p, "event_type").groupBy("event_type").agg(*[F.avg((F.col("value") <= F.col(c)).cast("double")).alias(c) for c in ("p50", "p90", "p99")], F.max("n").alias("n")).collect():
        assert abs(r.p50 - 0.5) < S.rank_error() and abs(r.p90 - 0.9) < S.rank_error() and abs(r.p99 - 0.99) < S.rank_error() and r.n > 10_000
    assert S.latency_from_sketches(spark.read.parquet(f"{path}/l"), until="1970-01-01 01:00:00").agg(F.sum("n")).first()[0] < 10_000
    plan = S.latency_from_sketches(spark.read.parquet(f"{path}/l"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,n:bigint,sketch:binary>" in plan
    turns = spark.createDataFrame([(i, 0, "user", f"w{i % 7} " + "common " * (i % 3)) for i in range(300)], SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 60))
    S.write_topic_sketches(turns, f"{path}/t", "ts")
    got = [tuple(r) for r in S.topics_from_sketches(spark.read.parquet(f"{path}/t"), 4).collect()]
    assert got == [tuple(r) for r in C.global_topics(turns, 4).collect()]
