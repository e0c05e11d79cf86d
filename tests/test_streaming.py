"""Streaming operators equal their batch twins on the same table."""
import os

from pyspark.sql import functions as F

from sift.operators import conversations as C
from sift.operators import questions as Q
from sift.operators.lexical import build_tfidf
from sift.plans.inputs import line_chunks
from sift.streaming import live as K

SF = "/root/testdata/sf0.001"


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_k2_analysis_stream_equals_batch(spark):
    s = K.table_stream(spark, SF, "conversations").filter(F.col("role") == "user")
    out = K.run_to_table(K.analyze_stream(s.select("conv_id", "turn", "text")), "k2")
    b = Q.analyze_questions(spark.read.parquet(f"{SF}/conversations.parquet").filter(F.col("role") == "user"))
    cols = ["conv_id", "turn", "query_type", "confidence"]
    assert rows(out, cols) == rows(b, cols)


def test_k4_history_stream_equals_batch(spark):
    s = K.table_stream(spark, SF, "conversations")
    out = K.run_to_table(K.history_stream(s, 6), "k4")
    b = C.history_slice(spark.read.parquet(f"{SF}/conversations.parquet"), 6)
    cols = ["conv_id", "turn", "history_size", "history_text"]
    assert rows(out, cols) == rows(b, cols)


def test_k5_k6_windows_stream_equals_batch(spark):
    """Append mode emits a window once the watermark (max event time - 1 hour)
    has passed its end: the stream equals the batch result restricted to those."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    max_us = ev.select(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0]
    wm = max_us - 3600 * 1_000_000
    for fn, end, cols in ((K.session_activity, "session_end_us", ["user_id", "session_start_us", "events", "purchases"]),
                          (K.hourly_quality, "hour_start_us", ["hour_start_us", "event_type", "requests", "slow"])):
        out = K.run_to_table(fn(K.table_stream(spark, SF, "events")), fn.__name__)
        b = fn(ev)
        closed = b.filter(F.col(end) + (0 if end == "session_end_us" else 3600 * 1_000_000) <= wm)
        got = rows(out, cols)
        assert got == rows(closed, cols) and len(got) > 0


def test_k1_ingest_is_idempotent(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in")
    os.makedirs(os.path.join(src, "sub"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5).collect()
    for i, d in enumerate(docs):
        with open(os.path.join(src, "sub" if i % 2 else "", f"d{i}.txt"), "w", encoding="utf-8") as f:
            f.write(d.text)
    coll = os.path.join(tmpdir_fresh, "coll")
    ck = os.path.join(tmpdir_fresh, "ck")
    K.ingest_corpus(spark, src, coll, 350, 50, ("\n\n", "\n", ". ", " ", ""), checkpoint=ck)
    n1 = spark.read.parquet(coll).count()
    K.ingest_corpus(spark, src, coll, 350, 50, ("\n\n", "\n", ". ", " ", ""), checkpoint=ck)
    assert spark.read.parquet(coll).count() == n1 > 0


def test_k3_retrieve_stream(spark, tmpdir_fresh):
    vocab, post = build_tfidf(line_chunks(spark, SF))
    qs = K.table_stream(spark, SF, "benchmark").select(F.col("item_id").alias("qid"), "text")
    out = os.path.join(tmpdir_fresh, "hits")
    K.retrieve_stream(qs, vocab, post, out, k=5, checkpoint=os.path.join(tmpdir_fresh, "ck"))
    import __spark_entry__ as E
    batch = E.queries()["d7_lexical_search"](spark, SF).filter(F.col("rank") <= 5)
    assert rows(spark.read.parquet(out), ["qid", "chunk_id", "rank"]) == rows(batch, ["qid", "chunk_id", "rank"])


def test_k1_registered_stream_equals_batch_chunks(spark):
    import __spark_entry__ as E
    q = E.queries()
    cols = ["doc_id", "chunk_no", "start_index", "content"]
    assert rows(q["k1_ingest_stream"](spark, SF), cols) == rows(q["b1_recursive_chunks"](spark, SF), cols)


def test_k4_idle_sessions_are_forgotten(spark, tmpdir_fresh):
    import datetime as dt
    import time
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    steps = [[(1, 0, 0), (2, 0, 0)], [(1, 1, 1)], [(3, 0, 60)], [(3, 1, 61)], [(1, 2, 62), (3, 2, 62)]]
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    src = os.path.join(tmpdir_fresh, "in")
    for i, rows in enumerate(steps):
        data = [(c, t, "user", f"m{c}.{t}", day + dt.timedelta(hours=h)) for c, t, h in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r.conv_id, r.turn): r.history_size for r in K.run_to_table(K.history_stream(s, 6, "ts", 24 * 3600), "k4-idle").collect()}
    assert got[(1, 1)] == 1 and got[(3, 2)] == 2
    assert got[(1, 2)] == 0  # two days later the session has been dropped


def _history_of_steps(spark, folder, steps, name, **args):
    """History of micro-batches [(conv_id, turn, hour)], each one file."""
    import datetime as dt
    import time
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    src = os.path.join(folder, "in")
    for step in steps:
        data = [(c, t, "user", f"m{c}.{t}", day + dt.timedelta(hours=h)) for c, t, h in step]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    return {(r.conv_id, r.turn): r.history_size for r in K.run_to_table(K.history_stream(s, 6, "ts", **args), name).collect()}


def test_k4_sessions_out_of_global_order_keep_their_messages(spark, tmpdir_fresh):
    steps = [[(1, 0, 20)], [(2, 0, 5)], [(1, 1, 21)], [(2, 1, 6), (1, 2, 22)], [(2, 2, 7)]]
    got = _history_of_steps(spark, tmpdir_fresh, steps, "k4-order", idle_seconds=24 * 3600)
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (2, 0): 0, (2, 1): 1, (2, 2): 2}


def test_k4_lateness_is_a_parameter(spark, tmpdir_fresh):
    steps = [[(1, 0, 20)], [(1, 1, 21)], [(2, 0, 5), (3, 0, 19)]]
    got = _history_of_steps(spark, tmpdir_fresh, steps, "k4-late", idle_seconds=24 * 3600, lateness_seconds=3 * 3600)
    assert got == {(1, 0): 0, (3, 0): 0, (1, 1): 1}  # hour 5 is older than 20 - 3


def _messages(spark, folder, steps, fn):
    """Runs ``fn(stream)`` over micro-batches [(conv_id, turn, role, text, second)], each one file; rows and the dropped count."""
    import datetime as dt
    import time
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    src, out = os.path.join(folder, "in"), os.path.join(folder, "out")
    for step in steps:
        spark.createDataFrame([(*m[:4], day + dt.timedelta(seconds=m[4])) for m in step], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    from sift.streaming.sessions import state_store
    with state_store(spark):
        s = fn(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
        q = (s.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", os.path.join(folder, "ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    late = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    return spark.read.parquet(out).collect(), late


def test_k4_messages_late_within_the_lateness_take_their_place(spark, tmpdir_fresh):
    from sift.streaming.sessions import ordered_history
    u = lambda c, t, at: (c, t, "user", f"m{c}.{t}", at)
    steps = [[u(1, 2, 120), u(1, 0, 0)], [u(1, 1, 60), u(2, 0, 30)], [u(1, 4, 1000)], [u(1, 3, 900)], [u(2, 1, 20), u(3, 0, 2000)], [u(9, 0, 9000)]]
    got, late = _messages(spark, tmpdir_fresh, steps, lambda s: ordered_history(s, "ts", 3, lateness_seconds=300, idle_seconds=5000))
    by = {(r.conv_id, r.turn): r.history_text for r in got}
    assert by == {(1, 0): "", (1, 1): "user: m1.0", (1, 2): "user: m1.0\nuser: m1.1", (2, 0): "", (3, 0): "",
                  (1, 3): "user: m1.0\nuser: m1.1\nuser: m1.2", (1, 4): "user: m1.1\nuser: m1.2\nuser: m1.3"}
    assert late == 1  # (2, 1) is of 20 s and came when the watermark stood at 700 s


def test_k5_sessions_are_summed_up_when_they_go_idle(spark, tmpdir_fresh):
    from sift.streaming.sessions import live_summaries
    steps = [[(1, 0, "user", "Inventory inventory question", 0), (1, 1, "assistant", "yes", 10)], [(1, 2, "user", "again question", 20), (2, 0, "user", "hi", 30)],
             [(1, 3, "assistant", "ok", 5000), (1, 4, "user", "x", 5010)], [(3, 0, "user", "later", 20_000)], [(3, 1, "user", "much", 40_000)]]
    got, late = _messages(spark, tmpdir_fresh, steps, lambda s: live_summaries(s, "ts", idle_seconds=600, lateness_seconds=60))
    day = 1704067200
    found = sorted((r.conv_id, r.session_start_us // 10 ** 6 - day, r.session_end_us // 10 ** 6 - day, r.total_exchanges, r.common_topics) for r in got)
    assert found == [(1, 0, 20, 1, "inventory, question, again"), (1, 5000, 5010, 1, ""), (2, 30, 30, 0, ""), (3, 20_000, 20_000, 0, "later")]
    assert late == 0
