"""Hot-key shapes: one session holding most rows, clustered document ids.

The skew-proof formulations (keyed joins on turn offsets, two-level running
sums, bucketed global numbering) must equal the plain window formulations.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from sift.operators import conversations as C
from sift.operators.chunking import with_chunk_ids

SF = "/root/testdata/sf0.01"


def hot_turns(spark):
    """All conversations folded into session -1 (turns renumbered densely), plus the originals."""
    t = spark.read.parquet(f"{SF}/conversations.parquet")
    hot = t.withColumn("turn", (F.row_number().over(Window.orderBy("conv_id", "turn")) - 1).cast("long")) \
           .withColumn("conv_id", F.lit(-1).cast("long"))
    return t.unionByName(hot)


def test_exchanges_and_history_on_hot_session(spark):
    t = hot_turns(spark)
    w = Window.partitionBy("conv_id").orderBy("turn")
    plain = (t.withColumn("nr", F.lead("role").over(w)).withColumn("na", F.lead("text").over(w))
              .filter((F.col("role") == "user") & (F.col("nr") == "assistant"))
              .withColumn("exchange_no", F.row_number().over(w) - 1)
              .select("conv_id", F.col("turn").alias("q_turn"), "exchange_no"))
    got = C.exchanges(t).select("conv_id", "q_turn", "exchange_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.filter("conv_id = -1").count() > 200

    h = C.history_slice(t, 6).select("conv_id", "turn", "history_text")
    hp = (t.withColumn("l", F.collect_list(F.concat_ws(": ", "role", "text")).over(w.rowsBetween(-6, -1)))
           .filter(F.col("role") == "user")
           .select("conv_id", "turn", F.array_join("l", "\n").alias("history_text")))
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, hp.collect()))


def test_two_level_budget_on_hot_session(spark):
    t = hot_turns(spark)
    got = C.budget_memory(t, 1000, block=64).select("conv_id", "turn", "newer_tokens")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    plain = (C.budget_memory(t, 1000).select("conv_id", "turn", "tokens")
             .withColumn("newer_tokens", F.sum("tokens").over(w)).drop("tokens"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_global_numbering_with_clustered_ids(spark):
    # 3 clusters of document ids far apart, one holding most documents
    rows = [(d, c) for d in list(range(0, 900)) + [10**9 + i for i in range(50)] + [10**12 + i for i in range(5)]
            for c in range(d % 4 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int")
    got = with_chunk_ids(df, "doc_", parts=7).select("doc_id", "chunk_no", "chunk_index")
    want = df.withColumn("chunk_index", (F.row_number().over(Window.orderBy("doc_id", "chunk_no")) - 1).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_split_sessions_equal_session_windows_for_a_hot_user(spark):
    from sift.streaming.live import session_activity, session_activity_split
    ev = spark.read.parquet(f"{SF}/events.parquet")
    hot = ev.unionByName(ev.withColumn("user_id", F.lit(-1).cast(ev.schema["user_id"].dataType)))
    cols = session_activity(hot).columns
    assert sorted(map(tuple, session_activity_split(hot).select(*cols).collect())) == \
        sorted(map(tuple, session_activity(hot).collect()))
