"""Registered queries: conversations (H), prompts (I), latency (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import conversations as C
from ..operators import prompts as P
from ..operators.chunking import row_key
from ..operators.latency import exact_percentiles, latency_flag, latency_report
from ..operators.retrieval import likely_hits, retrieve
from ..session import drop_path, scratch_path, shared_dir
from ..sources.tables import table
from . import duck as D
from .inputs import bench_queries, chunk_vectors, line_chunks, query_vectors
from .registry import register


def _turns(spark, sf):
    return table(spark, sf, "conversations")


_EX = """ex AS (
  SELECT conv_id, turn AS q_turn, text AS question, next_text AS answer,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS exchange_no
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


@register("h1_exchanges", sql=f"WITH {_EX} SELECT conv_id, q_turn, exchange_no, question, answer FROM ex")
def h1_exchanges(spark, sf):
    return C.exchanges(_turns(spark, sf)).select("conv_id", "q_turn", "exchange_no", "question", "answer")


@register("h2_tail_history", sql="""SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 8""")
def h2_tail_history(spark, sf):
    return C.tail_history(_turns(spark, sf), 8).select("conv_id", "turn", "role", "text")


@register("h2_tail_history_short", sql="""SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3""")
def h2_tail_history_short(spark, sf):
    """The last 3 messages: shorter than most conversations, so rows are cut."""
    return C.tail_history(_turns(spark, sf), 3).select("conv_id", "turn", "role", "text")


@register("h3_memory_window", sql=f"""WITH {_EX},
w AS (SELECT conv_id, exchange_no,
        list('Human: ' || question || chr(10) || 'AI: ' || answer)
          OVER (PARTITION BY conv_id ORDER BY exchange_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS m FROM ex)
SELECT conv_id, exchange_no, coalesce(len(m), 0) AS memory_size, coalesce(array_to_string(m, chr(10)), '') AS memory_text
FROM w""")
def h3_memory_window(spark, sf):
    return C.memory_window(C.exchanges(_turns(spark, sf)), 2)


@register("h4_history_slice", sql="""WITH
w AS (SELECT conv_id, turn, role,
        list(role || ': ' || text)
          OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
SELECT conv_id, turn, coalesce(len(h), 0) AS history_size, coalesce(array_to_string(h, chr(10)), '') AS history_text
FROM w WHERE role = 'user'""")
def h4_history_slice(spark, sf):
    return C.history_slice(_turns(spark, sf), 6)


def _budget_sql(budget: int) -> str:
    return _BUDGET.replace("<= 1000", f"<= {budget}")


_BUDGET = f"""b AS (SELECT conv_id, turn, role, text, {D.word_count('text')} AS tokens,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
b2 AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newer_tokens FROM b),
b3 AS (SELECT *, newer_tokens <= 1000 AS kept FROM b2)"""


@register("h5_budget_memory", sql=f"""WITH {_BUDGET}
SELECT conv_id, turn, tokens, newer_tokens, kept FROM b3""")
def h5_budget_memory(spark, sf):
    return C.budget_memory(_turns(spark, sf), 1000).select("conv_id", "turn", "tokens", "newer_tokens", "kept")


@register("h5_memory_summary", sql=f"""WITH {_BUDGET}
SELECT conv_id, count_if(kept) AS kept_messages, sum(CASE WHEN kept THEN tokens ELSE 0 END) AS kept_tokens,
       count_if(NOT kept) AS overflow_messages FROM b3 GROUP BY conv_id""")
def h5_memory_summary(spark, sf):
    return C.memory_summary(C.budget_memory(_turns(spark, sf), 1000))


_FIRST_SENT = C.FIRST_SENTENCE_RE


@register("h5_overflow_digest", sql=f"""WITH {_BUDGET}
SELECT conv_id, (position // 100)::BIGINT AS page,
       string_agg(role || ': ' || regexp_extract(text, {D.lit(_FIRST_SENT)}, 1), chr(10) ORDER BY position) AS summary
FROM b3 WHERE NOT kept GROUP BY conv_id, position // 100""")
def h5_overflow_digest(spark, sf):
    return C.overflow_digest(C.budget_memory(_turns(spark, sf), 1000))


@register("h5_budget_memory_small", sql=f"""WITH {_budget_sql(40)}
SELECT conv_id, turn, tokens, newer_tokens, kept FROM b3""")
def h5_budget_memory_small(spark, sf):
    """A budget of 40 tokens, which most conversations overflow."""
    return C.budget_memory(_turns(spark, sf), 40).select("conv_id", "turn", "tokens", "newer_tokens", "kept")


@register("h5_overflow_digest_small", sql=f"""WITH {_budget_sql(40)}
SELECT conv_id, (position // 100)::BIGINT AS page,
       string_agg(role || ': ' || regexp_extract(text, {D.lit(_FIRST_SENT)}, 1), chr(10) ORDER BY position) AS summary
FROM b3 WHERE NOT kept GROUP BY conv_id, position // 100""")
def h5_overflow_digest_small(spark, sf):
    return C.overflow_digest(C.budget_memory(_turns(spark, sf), 40))


def _ranked_sql(budget: int, rounds: int = 5, keep: int = 3) -> str:
    steps = "".join(f""",
r{k} AS (SELECT m.conv_id, m.page, m.unit, m.i AS n, 0.15::DOUBLE + 0.85::DOUBLE * sum(m.w / d.t * r.r) AS r
       FROM m JOIN d ON d.conv_id = m.conv_id AND d.page = m.page AND d.unit = m.unit AND d.i = m.j
       JOIN r{k - 1} r ON r.conv_id = m.conv_id AND r.page = m.page AND r.unit = m.unit AND r.n = m.j GROUP BY ALL)""" for k in range(1, rounds + 1))
    return f"""WITH {_budget_sql(budget)},
ss AS (SELECT conv_id, (position // 100)::BIGINT AS page, position, i, {D.strip('parts[i]')} AS s
       FROM (SELECT conv_id, position, regexp_extract_all(coalesce(text, ''), {D.lit(C.SENTENCE_RE)}) AS parts FROM b3 WHERE NOT kept) x, range(1, len(parts) + 1) r(i)),
sn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, page ORDER BY position, i) - 1 AS n FROM ss WHERE length(s) > 0),
su AS (SELECT *, (n // 100)::BIGINT AS unit, list_distinct({D.words('lower(s)')}) AS w FROM sn),
m AS (SELECT a.conv_id, a.page, a.unit, a.n AS i, b.n AS j, CASE WHEN a.n = b.n THEN 0.0::DOUBLE ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w))::DOUBLE END AS w
      FROM su a JOIN su b ON a.conv_id = b.conv_id AND a.page = b.page AND a.unit = b.unit),
d AS (SELECT conv_id, page, unit, i, CASE WHEN sum(w) > 0 THEN sum(w) ELSE 1 END AS t FROM m GROUP BY ALL),
r0 AS (SELECT conv_id, page, unit, n, 1.0::DOUBLE AS r FROM su){steps},
best AS (SELECT su.conv_id, su.page, su.unit, su.n, su.s, row_number() OVER (PARTITION BY su.conv_id, su.page, su.unit ORDER BY round(r, 9) DESC, su.n) AS place
         FROM r{rounds} JOIN su ON su.conv_id = r{rounds}.conv_id AND su.page = r{rounds}.page AND su.unit = r{rounds}.unit AND su.n = r{rounds}.n)
SELECT conv_id, page, unit, string_agg(s, chr(10) ORDER BY n) AS summary FROM best WHERE place <= {keep} GROUP BY conv_id, page, unit"""


@register("h5_ranked_digest", sql=_ranked_sql(40))
def h5_ranked_digest(spark, sf):
    """The best sentences of each page of overflowed messages by graph ranking (budget of 40 tokens)."""
    return C.ranked_digest(C.budget_memory(_turns(spark, sf), 40))


@register("h6_transcript", sql="""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations)
SELECT conv_id, (position // 100)::BIGINT AS page,
  string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY position) AS transcript
FROM p GROUP BY conv_id, position // 100""")
def h6_transcript(spark, sf):
    return C.transcript(_turns(spark, sf))


_INSIGHTS = f"""msgs AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
n AS (SELECT conv_id, (count(*) // 2)::BIGINT AS total_exchanges FROM msgs GROUP BY conv_id),
u AS (SELECT conv_id, turn, i AS pos, w[i + 1] AS word
      FROM (SELECT conv_id, turn, {D.words('lower(text)')} AS w FROM msgs WHERE role = 'user') s,
           range(0, len(w)) r(i)),
wc AS (SELECT conv_id, word, count(*) AS cnt, min({{'turn': turn, 'pos': pos}}) AS f FROM u GROUP BY conv_id, word),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cnt DESC, f) AS r FROM wc),
r2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS r2 FROM r1
       WHERE r <= 5 AND (list_contains({D.str_list(L.TOPIC_TERMS)}, word) OR length(word) > 4)),
t AS (SELECT conv_id, string_agg(word, ', ' ORDER BY r2) AS common_topics FROM r2 WHERE r2 <= 3 GROUP BY conv_id),
ins AS (SELECT c.conv_id, coalesce(n.total_exchanges, 0) AS total_exchanges, coalesce(t.common_topics, '') AS common_topics
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) LEFT JOIN t USING (conv_id))"""


@register("h7_session_insights", sql=f"WITH {_INSIGHTS} SELECT * FROM ins")
def h7_session_insights(spark, sf):
    return C.session_insights(_turns(spark, sf))


@register("h8_session_summary", sql=f"""WITH {_INSIGHTS}
SELECT conv_id, 'exchanges: ' || CAST(total_exchanges AS VARCHAR) || '; topics: ' ||
       CASE WHEN common_topics = '' THEN 'none' ELSE common_topics END AS summary FROM ins""")
def h8_session_summary(spark, sf):
    return C.session_summary(C.session_insights(_turns(spark, sf)))


@register("h9_global_topics", sql=f"""SELECT word, count(*) AS cnt
FROM (SELECT unnest({D.words('lower(text)')}) AS word FROM conversations WHERE role = 'user')
GROUP BY word ORDER BY cnt DESC, word LIMIT 20""")
def h9_global_topics(spark, sf):
    return C.global_topics(_turns(spark, sf), 20)


@register("h9_sketched_topics", sql=f"""SELECT word, count(*) AS cnt
FROM (SELECT unnest({D.words('lower(text)')}) AS word FROM conversations WHERE role = 'user')
GROUP BY word ORDER BY cnt DESC, word LIMIT 20""")
def h9_sketched_topics(spark, sf):
    """The same topics from stored hourly sketches (turns are minutes here), combined."""
    from ..operators.sketches import topics_from_sketches, write_topic_sketches
    path = scratch_path(spark, "topic-sketches")
    write_topic_sketches(_turns(spark, sf).withColumn("ts", F.expr("timestamp_seconds(60 * turn)")), path, "ts")
    return drop_path(spark, path, topics_from_sketches(spark.read.parquet(path), 20))


# ------------------------------------------------------------------ I

def _sem_hits(spark, sf, k):
    hits = retrieve(query_vectors(spark, sf), chunk_vectors(spark, sf), k, metric="cosine")
    return hits.join(line_chunks(spark, sf).select("chunk_id", "content", "source"), "chunk_id")


def _sem_sql(k: int) -> str:
    return f"""{D.line_chunks_cte()},
bq AS (SELECT item_id AS qid, text FROM benchmark),
{D.hash_embed_ctes('qv', 'bq', 'qid', 'text')},
{D.hash_embed_ctes('cv', 'line_chunks', 'chunk_id', 'content')},
{D.semantic_hits_cte('sh', 'qv', 'cv', k)},
hits AS (SELECT sh.qid, sh.chunk_id, sh.rank, c.content, c.source FROM sh JOIN line_chunks c USING (chunk_id))"""


_CTX = "ctx AS (SELECT qid, count(*) AS n_docs, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY qid)"


@register("i1_build_context", sql=f"WITH {_sem_sql(3)}, {_CTX} SELECT qid, n_docs, context FROM ctx")
def i1_build_context(spark, sf):
    return P.build_context(_sem_hits(spark, sf, 3))


@register("i2_cap_context", sql=f"""WITH {_sem_sql(5)},
t AS (SELECT *, {D.word_count('content')} AS tokens FROM hits),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM t)
SELECT qid, chunk_id, rank, tokens FROM c WHERE cum <= 1500""")
def i2_cap_context(spark, sf):
    return P.cap_context(_sem_hits(spark, sf, 5), 1500).select("qid", "chunk_id", "rank", "tokens")


@register("i2_cap_context_small", sql=f"""WITH {_sem_sql(5)},
t AS (SELECT *, {D.word_count('content')} AS tokens FROM hits),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM t)
SELECT qid, chunk_id, rank, tokens FROM c WHERE cum <= 60""")
def i2_cap_context_small(spark, sf):
    """A cap that drops hits."""
    return P.cap_context(_sem_hits(spark, sf, 5), 60).select("qid", "chunk_id", "rank", "tokens")


def _template_sql(template: str, slots: dict[str, str]) -> str:
    import re
    parts = re.split(r"(\{[a-z_]+\})", template)
    out = []
    for p in parts:
        if p.startswith("{") and p.endswith("}") and p[1:-1] in slots:
            out.append(f"coalesce({slots[p[1:-1]]}, '')")
        elif p:
            out.append(D.lit(p))
    return " || ".join(out)


@register("i3_render_prompts", sql=f"""WITH {_sem_sql(3)}, {_CTX}
SELECT b.qid, {_template_sql(P.DEFAULT_TEMPLATE, {'context': 'x.context', 'question': 'b.text', 'chat_history': "''"})} AS prompt
FROM bq b LEFT JOIN ctx x USING (qid)""")
def i3_render_prompts(spark, sf):
    q = bench_queries(spark, sf).withColumnRenamed("text", "question")
    x = q.join(P.build_context(_sem_hits(spark, sf, 3)), "qid", "left")
    return P.render_prompts(x, P.DEFAULT_TEMPLATE, history_col=None).select("qid", "prompt")


def _generate_sql() -> str:
    from .q_text import clean_ctes
    prompt = _template_sql(P.DEFAULT_TEMPLATE, {"context": "x.context", "question": "b.text", "chat_history": "''"})
    return f"""WITH {_sem_sql(3)}, {_CTX}, pr AS (SELECT b.qid, {prompt} AS prompt FROM bq b LEFT JOIN ctx x USING (qid)),
an AS (SELECT qid, 'Answer: ' || replace(substring(prompt, 80, 700), chr(10), ' ') AS answer FROM pr),
{clean_ctes('fast', 'an')} SELECT qid, cleaned FROM cl"""


@register("i4_generate_hook", sql=_generate_sql())
def i4_generate_hook(spark, sf):
    """Answers made by a batch function of the prompt (a stand-in for a model call), then cleaned."""
    from ..operators import answers as A

    def generate(prompts):
        def run(frames):
            for f in frames:
                yield f.assign(answer=["Answer: " + p[79:779].replace("\n", " ") for p in f["prompt"]])[["qid", "answer"]]
        return prompts.mapInPandas(run, "qid long, answer string")

    x = P.run_profile(bench_queries(spark, sf).withColumnRenamed("text", "question"),
                      lambda q: retrieve(query_vectors(spark, sf), chunk_vectors(spark, sf), 3, metric="cosine"), line_chunks(spark, sf), None, None,
                      clean=lambda d: A.clean_answers(d, "answer", "fast"), validate=None, generate=generate)
    return x.select("qid", "cleaned")


# ------------------------------------------------------------------ J

@register("j1_latency_report", sql="""SELECT event_type, count(*) AS requests, count_if(value > 30.0) AS slow,
  round(avg(value), 6) AS mean_seconds, min(value) AS min_seconds, max(value) AS max_seconds,
  count_if(value > 30.0) / count(*) AS slow_share FROM events GROUP BY event_type""")
def j1_latency_report(spark, sf):
    return latency_report(table(spark, sf, "events")).withColumn("mean_seconds", F.round("mean_seconds", 6))


@register("j1_latency_flags", sql="""SELECT event_id, CASE WHEN value > 30.0 THEN 'slow' ELSE 'acceptable' END AS flag
FROM events""")
def j1_latency_flags(spark, sf):
    return table(spark, sf, "events").select("event_id", latency_flag("value").alias("flag"))


@register("j1_latency_percentiles", sql="""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90,
  quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def j1_latency_percentiles(spark, sf):
    p = exact_percentiles(table(spark, sf, "events"))
    return p.select("event_type", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@register("j1_sketched_percentiles")
def j1_sketched_percentiles(spark, sf):
    """Percentiles from stored hourly sketches; the share of the values at or below each one shows the error."""
    from ..operators.sketches import latency_from_sketches, write_latency_sketches
    path, events = scratch_path(spark, "latency-sketches"), table(spark, sf, "events")
    write_latency_sketches(events, path)
    p = latency_from_sketches(spark.read.parquet(path))
    at = [F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"share_{c}") for c in ("p50", "p90", "p99")]
    shares = events.select("event_type", "value").join(p, "event_type").groupBy("event_type").agg(*at)
    return drop_path(spark, path, p.join(shares, "event_type"))


# ------------------------------------------------------------------ I4 (end to end, profile "improved")

def _i4_sql() -> str:
    from ..functions import lexicons as L  # noqa: F811
    from .q_text import clean_ctes
    tmpl = _template_sql(P.DEFAULT_TEMPLATE, {"context": "context", "question": "question",
                                              "chat_history": "chat_history"})
    return f"""WITH {D.line_chunks_cte()}, {_EX},
qq AS (SELECT printf('%020d:%010d', conv_id, q_turn) AS qid, conv_id, q_turn, question, answer FROM ex),
{D.hash_embed_ctes('qv', 'qq', 'qid', 'question')},
{D.hash_embed_ctes('cv', 'line_chunks', 'chunk_id', 'content')},
{D.semantic_hits_cte('sh', 'qv', 'cv', 3, 'l2')},
hits AS (SELECT sh.qid, sh.rank, c.content FROM sh JOIN line_chunks c USING (chunk_id)),
ctx AS (SELECT qid, count(*) AS n_docs, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context
        FROM hits GROUP BY qid),
hw AS (SELECT conv_id, turn, role, list(role || ': ' || text)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations),
hist AS (SELECT printf('%020d:%010d', conv_id, turn) AS qid, coalesce(array_to_string(h, chr(10)), '') AS chat_history
         FROM hw WHERE role = 'user'),
x AS (SELECT qq.qid, qq.conv_id, qq.q_turn, qq.question, qq.answer, coalesce(ctx.n_docs, 0) AS n_docs, ctx.context,
             hist.chat_history FROM qq LEFT JOIN ctx USING (qid) LEFT JOIN hist USING (qid)),
x2 AS (SELECT *, {tmpl} AS prompt FROM x),
{clean_ctes('improved', 'x2')},
g AS (SELECT *, {D.g_confidence('answer', L)} AS c1, {D.g_relevance('answer', 'question', 'n_docs')} AS c2,
             {D.g_completeness('answer', L)} AS c3, {D.g_clarity('answer', L)} AS c4 FROM cl),
g2 AS (SELECT *, c1 * {D.dbl(0.3)} + c2 * {D.dbl(0.3)} + c3 * {D.dbl(0.2)} + c4 * {D.dbl(0.2)} AS overall FROM g)
SELECT qid, n_docs, length(prompt) AS prompt_chars, cleaned, round(overall, 6) AS overall_quality,
       overall >= {D.dbl(0.6)} AS validation_passed FROM g2"""


@register("i4_run_profile", sql=_i4_sql())
def i4_run_profile(spark, sf):
    from ..operators import answers as A
    from ..operators.embedding import DEFAULT_DIM, hash_embed
    turns = _turns(spark, sf)
    ex = C.exchanges(turns)
    qs = ex.select(row_key("conv_id", "q_turn").alias("qid"), "question", "answer")
    hist = C.history_slice(turns, 6).select(row_key("conv_id", "turn").alias("qid"),
                                            F.col("history_text").alias("chat_history"))
    shared_dir(spark)
    chunks = line_chunks(spark, sf)
    asked = hash_embed(qs.select("qid", "question"), "qid", "question")
    hits = retrieve(asked, chunk_vectors(spark, sf), 3, metric="l2", sized=(chunks, DEFAULT_DIM)).checkpoint()  # 3 rows a question

    x = P.run_profile(
        qs.select("qid", "question"), lambda q: hits, _hit_rows(chunks, hits.select("chunk_id").distinct()), hist, qs.select("qid", "answer"),
        clean=lambda d: A.clean_answers(d, "answer", "improved"),
        validate=lambda d: A.validate_answers(d, "answer", "question", "n_docs"))
    return x.select("qid", "n_docs", F.length("prompt").alias("prompt_chars"), "cleaned",
                    F.round("overall_quality", 6).alias("overall_quality"), "validation_passed")


# ------------------------------------------------------------------ I4 for every profile

def profile_chunks(spark, sf, p):
    """The documents cut by the profile's own chunking preset (B1), as (chunk_id, doc_id, source, content)."""
    from ..operators.chunking import chunk_documents
    spec = p.chunk
    ch = chunk_documents(table(spark, sf, "documents"), spec.size, spec.overlap, spec.separators, keep=("source",))
    return ch.select(row_key("doc_id", "chunk_no").alias("chunk_id"), "doc_id", "source", "content")


def _hit_rows(chunks, ids):
    """The rows of a chunk table that have these (distinct) ids."""
    return likely_hits(chunks.select("chunk_id", "content", "source"), ids).join(ids, "chunk_id")


def _profile_hits(spark, sf, p, qs, chunks=None, kept=None):
    """(qid, chunk_id, rank) of the profile's retriever for questions (qid, question).

    A retriever that needs its candidates' rows reads them once more, embeds these alone and adds them to ``kept``.
    """
    from ..operators.embedding import DEFAULT_DIM, hash_embed
    from ..operators.hybrid import hybrid_search
    from ..operators.lexical import build_tfidf, keyword_search
    from ..operators.retrieval import mmr, semantic_search
    qv = hash_embed(qs, "qid", "question")
    chunks = line_chunks(spark, sf) if chunks is None else chunks
    cv = hash_embed(chunks, "chunk_id", "content")
    sized = chunks, DEFAULT_DIM  # counted without making the vectors
    if p.retriever == "mmr":
        def fetch(ids):
            rows = _hit_rows(chunks, ids).checkpoint()
            if kept is not None:
                kept.append(rows)
            return hash_embed(rows, "chunk_id", "content")

        return mmr(qv, cv, k=p.k, fetch_k=2 * p.k, lam=0.5, metric=p.metric, fetch=fetch, sized=sized).withColumnRenamed("pick", "rank")
    if p.retriever == "hybrid":
        vocab, _ = build_tfidf(chunks)
        lex = keyword_search(qs, chunks, 2 * p.k, vocab, qtext_col="question").checkpoint()
        sem = semantic_search(qv, cv, 2 * p.k, p.metric, sized=sized).checkpoint()
        rows = _hit_rows(chunks, sem.select("chunk_id").unionByName(lex.select("chunk_id")).distinct()).checkpoint()
        if kept is not None:
            kept.append(rows)
        return hybrid_search(sem, lex, rows, p.k).select("qid", "chunk_id", "rank")
    return retrieve(qv, cv, p.k, metric=p.metric, sized=sized)


def _profile_history(turns, p):
    """What the profile shows of the conversation: the last messages, or its memory of exchanges."""
    if p.memory_exchanges and p.history_slice < 0:
        m = C.memory_window(C.exchanges(turns), p.memory_exchanges)
        ex = C.exchanges(turns).select("conv_id", "q_turn", "exchange_no")
        return m.join(ex, ["conv_id", "exchange_no"]).select(row_key("conv_id", "q_turn").alias("qid"), F.col("memory_text").alias("chat_history"))
    n = p.history_messages if p.history_slice < 0 else p.history_slice
    return C.history_slice(turns, n).select(row_key("conv_id", "turn").alias("qid"), F.col("history_text").alias("chat_history"))


def _profile_table(spark, sf, name: str):
    from .profiles import PROFILES
    return profile_chunks(spark, sf, PROFILES[name])


def run_request_table(spark, sf, name: str, chunks=None):
    """I4 as the profile runs it: E1, E2, its retriever, context cap, prompt, cleaning, sources and (advanced) validation.

    ``chunks``: the corpus table (``profile_chunks``, or any other); default: lines.
    """
    from ..operators import answers as A
    from ..operators import questions as Q
    from ..operators.hybrid import cited_sources
    from .profiles import PROFILES
    p = PROFILES[name]
    turns = _turns(spark, sf)
    ex = Q.non_blank(C.exchanges(turns), "question")
    asked = Q.enhance_question("question", p.domain_keywords) if p.domain_keywords else F.col("question")
    qs = ex.select(row_key("conv_id", "q_turn").alias("qid"), asked.alias("question"), "answer")
    shared_dir(spark)
    path = scratch_path(spark, "request-chunks")  # the corpus is read for several steps, and cut once
    (line_chunks(spark, sf) if chunks is None else chunks).select("chunk_id", "source", "content").write.parquet(path)
    chunks = spark.read.parquet(path)
    kept = []
    hits = _profile_hits(spark, sf, p, qs.select("qid", "question"), chunks, kept).checkpoint()  # k rows a question, used for contexts and sources
    chunks = kept[0] if kept else _hit_rows(chunks, hits.select("chunk_id").distinct()).checkpoint()  # the hits' own
    drop_path(spark, path)
    x = P.run_profile(
        qs.select("qid", "question"), lambda q: hits, chunks, _profile_history(turns, p), qs.select("qid", "answer"),
        clean=lambda d: A.clean_answers(d, "answer", name, key="qid"),
        validate=(lambda d: A.validate_answers(d, "answer", "question", "n_docs")) if p.validate else None, max_tokens=p.context_tokens)
    if p.source_cap:
        s = cited_sources(hits.join(chunks.select("chunk_id", "source"), "chunk_id"), p.source_cap, default=p.source_default, docs=p.source_docs)
        x = x.join(s, "qid", "left")
    out = ["qid", "n_docs", F.length("prompt").alias("prompt_chars"), F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"), "cleaned"]
    if p.source_cap:
        out += [F.array_join("sources", "|").alias("sources"), F.coalesce("more_sources", F.lit(0)).alias("more_sources")]
    if p.validate:
        out += [F.round("overall_quality", 6).alias("overall_quality"), "validation_passed"]
    return x.select(*out)


def _request_sql(name: str, chunks: str | None = None) -> str:
    """``chunks``: a table (chunk_id, source, content) to take instead of the lines."""
    from .profiles import PROFILES
    from .q_retrieval import mmr_sql
    from .q_text import clean_ctes
    p = PROFILES[name]
    asked = (f"CASE WHEN {D.contains_any('lower(question)', p.domain_keywords)} THEN question ELSE {D.lit(L.DOMAIN_PREFIX)} || question END"
             if p.domain_keywords else "question")
    corpus = f"line_chunks AS (SELECT * FROM {chunks})" if chunks else D.line_chunks_cte()
    head = f"""{corpus}, {_EX},
qq AS (SELECT printf('%020d:%010d', conv_id, q_turn) AS qid, conv_id, q_turn, {asked} AS question, answer FROM ex
       WHERE length({D.strip('question')}) > 0),
{D.hash_embed_ctes('qv', 'qq', 'qid', 'question')},
{D.hash_embed_ctes('cv', 'line_chunks', 'chunk_id', 'content')}"""
    if p.retriever == "mmr":
        ctes, pick = mmr_sql(head, p.k, 2 * p.k)
        head = f"{ctes},\nsh AS (SELECT qid, chunk_id, pick AS rank FROM ({pick}))"
    elif p.retriever == "hybrid":
        head += f""",
{D.tfidf_ctes('line_chunks')}, {D.query_weight_ctes('qq', 'qid', 'question', 'ix_vocab')},
{D.lexical_hits_cte('lex', 'qw', 'ix_post', 2 * p.k)}, {D.semantic_hits_cte('sem', 'qv', 'cv', 2 * p.k, p.metric)},
{D.hybrid_ctes('sem', 'lex', 'line_chunks', p.k)}, sh AS (SELECT qid, chunk_id, rank FROM hyb)"""
    else:
        head += f", {D.semantic_hits_cte('sh', 'qv', 'cv', p.k, p.metric)}"
    if p.memory_exchanges and p.history_slice < 0:
        hist = f"""hist AS (SELECT printf('%020d:%010d', conv_id, q_turn) AS qid, coalesce(array_to_string(m, chr(10)), '') AS chat_history FROM (
  SELECT conv_id, q_turn, list('Human: ' || question || chr(10) || 'AI: ' || answer)
    OVER (PARTITION BY conv_id ORDER BY exchange_no ROWS BETWEEN {p.memory_exchanges} PRECEDING AND 1 PRECEDING) AS m FROM ex))"""
    else:
        n = p.history_messages if p.history_slice < 0 else p.history_slice
        hist = f"""hist AS (SELECT printf('%020d:%010d', conv_id, turn) AS qid, coalesce(array_to_string(h, chr(10)), '') AS chat_history FROM (
  SELECT conv_id, turn, role, list(role || ': ' || text)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS h FROM conversations) WHERE role = 'user')"""
    tmpl = _template_sql(P.DEFAULT_TEMPLATE, {"context": "context", "question": "question", "chat_history": "chat_history"})
    before, _, after = p.source_default.partition("{i}")
    unknown = f"{D.lit(before)} || CAST(rank AS VARCHAR) || {D.lit(after)}" if "{i}" in p.source_default else D.lit(p.source_default)
    cols, tail = "", ""
    if p.source_cap:
        cut = f"WHERE rank <= {p.source_docs}" if p.source_docs else ""
        hist += f""",
sf AS (SELECT qid, coalesce(regexp_extract(source, '([^/\\\\]*)$', 1), {unknown}) AS file, min(rank) AS first FROM hits {cut} GROUP BY qid, file),
src AS (SELECT qid, array_to_string(list(file ORDER BY first)[1:{p.source_cap}], '|') AS sources, greatest(count(*) - {p.source_cap}, 0) AS more_sources FROM sf GROUP BY qid)"""
        cols, tail = ", src.sources, coalesce(src.more_sources, 0) AS more_sources", " LEFT JOIN src USING (qid)"
    if p.validate:
        q = [D.g_confidence("answer", L), D.g_relevance("answer", "question", "n_docs"), D.g_completeness("answer", L), D.g_clarity("answer", L)]
        overall = " + ".join(f"({x}) * {D.dbl(w)}" for x, w in zip(q, (0.3, 0.3, 0.2, 0.2)))
        cols += f", round({overall}, 6) AS overall_quality, ({overall}) >= {D.dbl(0.6)} AS validation_passed"
    return f"""WITH {head},
hits AS (SELECT sh.qid, sh.rank, c.content, c.source FROM sh JOIN line_chunks c USING (chunk_id)),
fit AS (SELECT *, sum({D.word_count('content')}) OVER (PARTITION BY qid ORDER BY rank) AS tokens FROM hits),
ctx AS (SELECT qid, count(*) AS n_docs, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM fit
        WHERE {f'tokens <= {p.context_tokens}' if p.context_tokens else 'true'} GROUP BY qid),
{hist},
x AS (SELECT qq.qid, qq.conv_id, qq.q_turn, qq.question, qq.answer, coalesce(ctx.n_docs, 0) AS n_docs, ctx.context, hist.chat_history
      FROM qq LEFT JOIN ctx USING (qid) LEFT JOIN hist USING (qid)),
x2 AS (SELECT *, {tmpl} AS prompt FROM x),
{clean_ctes(name, 'x2')}
SELECT cl.qid, n_docs, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5, cleaned{cols} FROM cl{tail}"""


for _name in ("fast", "flan", "orca", "advanced", "improved"):
    register(f"i4_request_{_name}", sql=_request_sql(_name))(lambda spark, sf, _n=_name: run_request_table(spark, sf, _n))


# The same on the chunks of the profile's own preset (B1 has no SQL form: the tests hand these chunks to the SQL above).
for _name in ("fast", "flan", "orca", "advanced", "improved"):
    register(f"i4_profile_{_name}")(lambda spark, sf, _n=_name: run_request_table(spark, sf, _n, _profile_table(spark, sf, _n)))
