"""Registered queries: batch twins of the streaming operators (K5, K6).

The same functions run on a file stream in ``sift.streaming.live``; the
tests check stream == batch.  K2's twin is ``e7_analyze_questions`` and K4's
is ``h4_history_slice``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.live import hourly_quality, session_activity
from .registry import register


@register("k5_session_activity", sql="""WITH
e AS (SELECT user_id, ts, event_type, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, epoch_us(min(ts)) AS session_start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS session_end_us,
       count(*) AS events, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'error') AS errors,
       round(avg(value), 6) AS mean_value
FROM s GROUP BY user_id, sid""")
def k5_session_activity(spark, sf):
    return session_activity(table(spark, sf, "events")).withColumn("mean_value", F.round("mean_value", 6))


@register("k6_hourly_quality", sql="""SELECT epoch_us(date_trunc('hour', ts)) AS hour_start_us, event_type,
       count(*) AS requests, count_if(value > 30.0) AS slow, round(avg(value), 6) AS mean_seconds
FROM events GROUP BY 1, 2""")
def k6_hourly_quality(spark, sf):
    return hourly_quality(table(spark, sf, "events")).withColumn("mean_seconds", F.round("mean_seconds", 6))


# Streaming runs: the table is read as a file stream, the operator runs to
# completion (availableNow) into a table under the shared folder, and that
# table is the result — checked against the same SQL as the batch twin.

from ..functions import lexicons as L  # noqa: E402
from ..session import drop_path  # noqa: E402
from ..streaming.live import analyze_stream, history_stream, run_to_table, table_stream  # noqa: E402
from . import duck as D  # noqa: E402


@register("k2_analysis_stream", sql=f"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
an AS (SELECT conv_id, turn, text, {D.classify('text', L.QUERY_PATTERNS)} AS query_type,
              {D.extract_terms('text', L.DOMAIN_SYNONYMS, L.EXTRA_DOMAIN_WORDS)} AS terms FROM u)
SELECT conv_id, turn, query_type, array_to_string(terms, '|') AS retail_terms,
       round({D.question_confidence('text', 'terms')}, 6) AS confidence FROM an""")
def k2_analysis_stream(spark, sf):
    s = table_stream(spark, sf, "conversations").filter(F.col("role") == "user")
    out = run_to_table(analyze_stream(s.select("conv_id", "turn", "text")), "k2")
    return out.select("conv_id", "turn", "query_type", F.array_join("retail_terms", "|").alias("retail_terms"),
                      F.round("confidence", 6).alias("confidence"))


@register("k4_history_stream", sql="""WITH
w AS (SELECT conv_id, turn, role,
        list(role || ': ' || text)
          OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
SELECT conv_id, turn, coalesce(len(h), 0) AS history_size, coalesce(array_to_string(h, chr(10)), '') AS history_text
FROM w WHERE role = 'user'""")
def k4_history_stream(spark, sf):
    out = run_to_table(history_stream(table_stream(spark, sf, "conversations"), 6), "k4")
    return out.select("conv_id", "turn", "history_size", "history_text")


from . import q_conv, q_corpus, q_retrieval  # noqa: E402,F401  (they register first)
from .registry import ORACLE as _ORACLE  # noqa: E402


@register("k3_retrieve_stream", sql=_ORACLE["d7_lexical_search"])
def k3_retrieve_stream(spark, sf):
    """Benchmark passages as a question stream, keyword top-10 of each micro-batch
    against the index of the document lines (oracle: d7's SQL)."""
    from ..operators.lexical import build_tfidf, load_index, save_index
    from ..session import scratch_path
    from ..streaming.live import retrieve_stream
    from .inputs import line_chunks
    path = scratch_path(spark, "k3-index")
    save_index(*build_tfidf(line_chunks(spark, sf)), path)
    vocab, post = load_index(spark, path)
    qs = table_stream(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    out = scratch_path(spark, "k3-hits")
    retrieve_stream(qs, vocab, post, out, k=10)
    return spark.read.parquet(out).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register("k1_ingest_stream")
def k1_ingest_stream(spark, sf):
    """The documents table as a stream, chunked (advanced preset) into a collection
    in the shared folder by the incremental upsert; the collection is the result."""
    from ..session import scratch_path
    from ..streaming.live import ingest_stream
    from .profiles import PROFILES
    spec = PROFILES["advanced"].chunk
    coll = scratch_path(spark, "k1-collection")
    docs = table_stream(spark, sf, "documents").select("doc_id", "source", "text")
    ingest_stream(docs, coll, spec.size, spec.overlap, spec.separators)
    return spark.read.parquet(coll).select("chunk_id", "doc_id", "source", "chunk_no", "start_index",
                                           "chunk_length", "content")


@register("k1_ingest_invariants", sql=_ORACLE["b1_chunk_invariants"])
def k1_ingest_invariants(spark, sf):
    """The ingested collection meets the invariants of batch chunking."""
    from .profiles import PROFILES
    from .q_corpus import _invariants
    return _invariants(table(spark, sf, "documents"), k1_ingest_stream(spark, sf), PROFILES["advanced"].chunk)


# K5 / K6 over conversations: a session's exchanges and topics, and answer quality by hour of the matching events.

@register("k5_session_summaries", sql=_ORACLE["h7_session_insights"])
def k5_session_summaries(spark, sf):
    """Exchanges and topics of every session whose messages came as a stream."""
    from ..operators.conversations import session_insights
    out = run_to_table(table_stream(spark, sf, "conversations"), "k5-messages")
    return session_insights(out)


@register("k5_session_activity_split", sql=_ORACLE["k5_session_activity"])
def k5_session_activity_split(spark, sf):
    """Batch sessionisation that splits hot users by time block (same sessions as k5)."""
    from ..streaming.live import session_activity_split
    return session_activity_split(table(spark, sf, "events")).select(
        "user_id", "session_start_us", "session_end_us", "events", "purchases", "errors", F.round("mean_value", 6).alias("mean_value"))


# Event time for conversations, which have none: a message a minute, two hours' rest after every fourth turn.
_TIMED = "timestamp_seconds(1700000000 + 60 * turn + 7200 * floor(turn / 4) + 60 * (conv_id % 7))"
LATE, IDLE = 601, 1800  # seconds; never a multiple of a minute, so no message stands at the watermark itself
_TIMED_SQL = f"""timed AS (SELECT *, (1700000000 + 60 * turn + 7200 * (turn // 4) + 60 * (conv_id % 7))::BIGINT AS t FROM conversations),
mark AS (SELECT max(t) - {LATE} AS w FROM timed)"""


def _timed_turns(spark, sf):
    return table_stream(spark, sf, "conversations").withColumn("ts", F.expr(_TIMED))


@register("k4_ordered_history_stream", sql=f"""WITH {_TIMED_SQL},
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY conv_id ORDER BY turn) >= 86400 THEN 1 ELSE 0 END AS fresh FROM timed),
h AS (SELECT *, list(coalesce(role, '') || ': ' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM f)
SELECT conv_id, turn, coalesce(len(h), 0)::INTEGER AS history_size, coalesce(array_to_string(h, chr(10)), '') AS history_text
FROM h, mark WHERE role = 'user' AND t <= w""")
def k4_ordered_history_stream(spark, sf):
    """History of every user message that the watermark has reached, from list state in event time order."""
    from ..streaming.sessions import ordered_history, state_store
    with state_store(spark):
        return run_to_table(ordered_history(_timed_turns(spark, sf), "ts", 6, LATE), "k4-ordered")


@register("k5_live_summaries", sql=f"""WITH {_TIMED_SQL},
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sid
      FROM (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM timed)),
closed AS (SELECT conv_id, sid, min(t) AS a, max(t) AS b, count_if(role IN ('user', 'assistant')) // 2 AS total_exchanges
           FROM s GROUP BY conv_id, sid HAVING max(t) + {IDLE} <= (SELECT w FROM mark)),
u AS (SELECT conv_id, sid, turn, i AS pos, w[i + 1] AS word
      FROM (SELECT conv_id, sid, turn, {D.words('lower(text)')} AS w FROM s WHERE role = 'user'), range(0, len(w)) r(i)),
wc AS (SELECT conv_id, sid, word, count(*) AS cnt, min({{'turn': turn, 'pos': pos}}) AS f FROM u GROUP BY conv_id, sid, word),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sid ORDER BY cnt DESC, f) AS r FROM wc),
r2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sid ORDER BY r) AS r2 FROM r1
       WHERE r <= 5 AND (list_contains({D.str_list(L.TOPIC_TERMS)}, word) OR length(word) > 4)),
tp AS (SELECT conv_id, sid, string_agg(word, ', ' ORDER BY r2) AS common_topics FROM r2 WHERE r2 <= 3 GROUP BY conv_id, sid)
SELECT c.conv_id, a * 1000000 AS session_start_us, b * 1000000 AS session_end_us, total_exchanges, coalesce(common_topics, '') AS common_topics
FROM closed c LEFT JOIN tp USING (conv_id, sid)""")
def k5_live_summaries(spark, sf):
    """Exchanges and topics of every session closed by inactivity, from a stream of messages."""
    from ..streaming.sessions import live_summaries, state_store
    with state_store(spark):
        return run_to_table(live_summaries(_timed_turns(spark, sf), "ts", IDLE, LATE), "k5-live")


@register("k3_hybrid_stream", sql=_ORACLE["d13_hybrid_search"])
def k3_hybrid_stream(spark, sf):
    """Benchmark passages as a question stream; hybrid top-5 of each micro-batch over stored vectors and chunks (oracle: d13's SQL)."""
    from ..operators import hybrid as H
    from ..operators.embedding import hash_embed
    from ..operators.lexical import build_tfidf, keyword_search
    from ..operators.retrieval import semantic_search
    from ..session import scratch_path
    from ..streaming.live import search_stream
    from .inputs import chunk_vectors, line_chunks
    path = scratch_path(spark, "k3-hybrid")
    line_chunks(spark, sf).write.parquet(f"{path}/chunks")
    chunk_vectors(spark, sf).write.parquet(f"{path}/vectors")
    chunks, vectors = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")
    vocab = build_tfidf(chunks)[0]

    def search(batch):
        sem = semantic_search(hash_embed(batch, "qid", "text"), vectors, 10, "cosine")
        return H.hybrid_search(sem, keyword_search(batch, chunks, 10, vocab), chunks, 5)

    search_stream(table_stream(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), search, f"{path}/hits")
    hits = H.round_scores(spark.read.parquet(f"{path}/hits").select("qid", "rank", "chunk_id", "content", "semantic_score", "keyword_score", "hybrid_score", "confidence"))
    return drop_path(spark, path, hits)


from .q_text import _G_CTE, N_SOURCES  # noqa: E402


@register("k6_pass_rate_stream", sql=f"""WITH {_G_CTE},
t AS (SELECT *, (1700000000 + 2400 * q_turn + 60 * (conv_id % 50))::BIGINT AS t FROM g3),
m AS (SELECT max(t) - 3600 AS w FROM t)
SELECT (t - t % 3600) * 1000000 AS hour_start_us, count(*) AS answers, count_if(validation_passed) AS passed, round(avg(overall_quality), 6) AS mean_quality
FROM t GROUP BY t - t % 3600 HAVING t - t % 3600 + 3600 <= (SELECT w FROM m)""")
def k6_pass_rate_stream(spark, sf):
    """Share of answers that pass validation, by hour, from a stream of answers; hours that the watermark has passed."""
    from ..session import scratch_path
    from ..streaming.live import hourly_pass_rate
    from .inputs import answers
    path = scratch_path(spark, "k6-answers")
    a = answers(spark, sf).withColumns({"n_sources": F.lit(N_SOURCES), "ts": F.expr("timestamp_seconds(1700000000 + 2400 * q_turn + 60 * (conv_id % 50))")})
    a.write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = run_to_table(hourly_pass_rate(stream, "ts"), "k6-pass-rate")
    return drop_path(spark, path, out.withColumn("mean_quality", F.round("mean_quality", 6)))
