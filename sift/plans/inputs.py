"""Inputs every registered query derives from the given tables.

* chunks   = non-blank lines of ``documents`` (B2), id ``row_key(doc_id, line)``
* queries  = whole ``benchmark`` passages (their text occurs inside documents)
* vectors  = ``embeddings``; vector queries = per-label centroids (one per label)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import row_key, split_chunks
from ..operators.embedding import hash_embed
from ..sources.tables import table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return split_chunks(documents(spark, sf).select("doc_id", "source", "text"))


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return hash_embed(line_chunks(spark, sf), "chunk_id", "content")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return hash_embed(bench_queries(spark, sf), "qid", "text")


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """(label, centroid ARRAY<DOUBLE>): mean vector per label.

    ``(label, position)`` averages (partial per task, so a label holding most
    rows is pre-aggregated), then one ordered array per label.
    """
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("_i", "_x"))
    m = e.groupBy("label", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    g = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return g.select(F.col("label").cast("long").alias("label"),
                    F.transform("_v", lambda s: s["_m"]).alias("embedding"))


# Questions: every user turn of ``conversations`` plus one templated question per
# ``part`` row (the template is picked by part key), so question analytics see
# real text and every class of the pattern table.
QUESTION_TEMPLATES = [
    ("Do you have ", "p_name", " in stock?"),
    ("How much is the ", "p_brand", " price for this item?"),
    ("Compare ", "p_name", " versus the rest of the range"),
    ("What is ", "p_type", " made of?"),
    ("How to choose a size ", "p_size", " product?"),
    ("Tell me about ", "p_name", ""),
    ("Best practices and tips for selling ", "p_brand", " goods"),
    ("Where is the nearest shop with ", "p_type", "?"),
]

def questions(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        row_key("conv_id", "turn").alias("qid"), "text")
    part = table(spark, sf, "part")
    k = F.pmod(F.col("p_partkey"), F.lit(len(QUESTION_TEMPLATES)))
    expr = None
    for i, (a, c, b) in enumerate(QUESTION_TEMPLATES):
        v = F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))
        expr = F.when(k == i, v) if expr is None else expr.when(k == i, v)
    tq = part.select(F.format_string("part:%020d", F.col("p_partkey").cast("long")).alias("qid"), expr.alias("text"))
    return conv.unionByName(tq)


def questions_sql() -> str:
    from . import duck as D
    cases = " ".join(f"WHEN {i} THEN {D.lit(a)} || CAST({c} AS VARCHAR) || {D.lit(b)}"
                     for i, (a, c, b) in enumerate(QUESTION_TEMPLATES))
    return f"""questions AS (
  SELECT printf('%020d:%010d', conv_id, turn) AS qid, text FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT printf('part:%020d', p_partkey) AS qid, CASE p_partkey % {len(QUESTION_TEMPLATES)} {cases} END AS text FROM part)"""


# Answers: every exchange (user turn + following assistant turn) of
# ``conversations``; the variant (by key) wraps the answer the way generated
# answers arrive — role prefixes, meta lines, empty output, doubled length —
# so every cleaning branch runs on table data.
ANSWER_VARIANTS = [
    ("", ""),
    ("Answer: ", ""),
    ("  assistant:   Response: ", ""),
    ("Based on the context provided, ", "\nSource: knowledge base"),
    ("", "\n\n{dup}"),
    (None, None),
    ("Context: see below\nok\n", "\nAccording to the document above."),
    ("Here's the thing. Specifically, ", " However, it might vary."),
]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.conversations import exchanges
    ex = exchanges(table(spark, sf, "conversations"))
    k = F.pmod(F.col("conv_id") + F.col("q_turn"), F.lit(len(ANSWER_VARIANTS)))
    expr = None
    for i, (a, b) in enumerate(ANSWER_VARIANTS):
        if a is None:
            v = F.lit("")
        elif b == "\n\n{dup}":
            v = F.concat(F.col("answer"), F.lit("\n\n"), F.col("answer"))
        else:
            v = F.concat(F.lit(a), F.col("answer"), F.lit(b))
        expr = F.when(k == i, v) if expr is None else expr.when(k == i, v)
    return ex.select("conv_id", "q_turn", "exchange_no", "question",
                     k.alias("variant"), expr.alias("answer"))


def answers_sql() -> str:
    from . import duck as D
    cases = []
    for i, (a, b) in enumerate(ANSWER_VARIANTS):
        if a is None:
            cases.append(f"WHEN {i} THEN ''")
        elif b == "\n\n{dup}":
            cases.append(f"WHEN {i} THEN answer || chr(10) || chr(10) || answer")
        else:
            cases.append(f"WHEN {i} THEN {D.lit(a)} || answer || {D.lit(b)}")
    return f"""ex AS (
  SELECT conv_id, turn AS q_turn, text AS question, next_text AS answer,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS exchange_no
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'),
answers AS (
  SELECT conv_id, q_turn, exchange_no, question, (conv_id + q_turn) % {len(ANSWER_VARIANTS)} AS variant,
         CASE (conv_id + q_turn) % {len(ANSWER_VARIANTS)} {' '.join(cases)} END AS answer FROM ex)"""
