"""Building prompts from retrieved hits, and the end-to-end request table.

Hit tables hold at most ``k`` rows per question, so the per-question
aggregates here are bounded by ``k``.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

# Default template (a parameter; any text with {context} {question} {chat_history} slots works).
DEFAULT_TEMPLATE = ("Answer the question using only the context below.\n\n"
                    "Context:\n{context}\n\n"
                    "Conversation so far:\n{chat_history}\n\n"
                    "Question: {question}\n"
                    "Answer:")


def build_context(hits: DataFrame, qid: str = "qid", rank_col: str = "rank",
                  content_col: str = "content", sep: str = "\n\n") -> DataFrame:
    """The retrieved texts of each question in rank order, joined by a blank line."""
    g = hits.groupBy(qid).agg(F.array_sort(F.collect_list(
        F.struct(F.col(rank_col).alias("r"), F.col(content_col).alias("c")))).alias("_h"),
        F.count(F.lit(1)).alias("n_docs"))
    return g.select(qid, "n_docs", F.array_join(F.transform("_h", lambda s: s["c"]), sep).alias("context"))


def cap_context(hits: DataFrame, max_tokens: int = 1500, qid: str = "qid", rank_col: str = "rank",
                content_col: str = "content") -> DataFrame:
    """Drop the lowest-ranked hits until the question's total tokens fit ``max_tokens``
    (the longest rank-ordered prefix within budget).  Tokens are whitespace words."""
    t = hits.withColumn("tokens", F.size(words(F.col(content_col))))
    w = Window.partitionBy(qid).orderBy(rank_col).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("_cum", F.sum("tokens").over(w)).filter(F.col("_cum") <= max_tokens).drop("_cum")


def render_template(template: str, slots: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots with columns (no regex, one concat)."""
    parts = re.split(r"(\{[a-z_]+\})", template)
    cols = []
    for p in parts:
        if p.startswith("{") and p.endswith("}") and p[1:-1] in slots:
            cols.append(F.coalesce(slots[p[1:-1]], F.lit("")))
        elif p:
            cols.append(F.lit(p))
    return F.concat(*cols) if cols else F.lit("")


def render_prompts(df: DataFrame, template: str = DEFAULT_TEMPLATE, context_col: str = "context",
                   question_col: str = "question", history_col: str | None = "chat_history",
                   out: str = "prompt") -> DataFrame:
    slots = {"context": F.col(context_col), "question": F.col(question_col)}
    slots["chat_history"] = F.col(history_col) if history_col and history_col in df.columns else F.lit("")
    return df.withColumn(out, render_template(template, slots))


def run_profile(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], chunks: DataFrame,
                history: DataFrame | None, answers: DataFrame | None, clean: Callable[[DataFrame], DataFrame],
                validate: Callable[[DataFrame], DataFrame] | None, max_tokens: int | None = None,
                template: str = DEFAULT_TEMPLATE, qid: str = "qid",
                generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """I4: questions -> retrieve -> context -> prompt -> answers -> clean -> validate.

    ``questions``: (qid, question); ``retrieve(questions) -> (qid, chunk_id, rank)``;
    ``chunks``: (chunk_id, content, ...); ``history``: (qid, chat_history) or None;
    ``answers``: (qid, answer) as a table, or ``generate((qid, prompt)) -> (qid, answer)``
    — a batch hook (for example an Arrow-batch model call) used when no table is given.
    """
    hits = retrieve(questions).join(chunks.select("chunk_id", "content"), "chunk_id")
    if max_tokens:
        hits = cap_context(hits, max_tokens, qid)
    ctx = build_context(hits, qid)
    x = questions.join(ctx, qid, "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    if history is not None:
        x = x.join(history, qid, "left")
    x = render_prompts(x, template, history_col="chat_history" if history is not None else None)
    if answers is None and generate is not None:
        answers = generate(x.select(qid, "prompt"))
    if answers is not None:
        x = x.join(answers, qid, "left")
        x = clean(x)
        if validate is not None:
            x = validate(x)
    return x
