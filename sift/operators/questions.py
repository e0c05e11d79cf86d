"""Question analytics as column expressions (no shuffle, no Python).

Matching is plain substring containment on the lower-cased question, in the
declared order where a first match wins — that is the intended semantics,
including its quirks (no word boundaries; a pattern with a capital letter can
never match lower-cased text).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import blank, col_, contains_any, py_strip, word_count, words


def non_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop questions that are empty after ``strip`` (they get a fixed reply, no retrieval)."""
    return df.filter(~blank(text_col))


def blank_reply(text_col: str = "text", reply: str = L.BLANK_REPLY) -> Column:
    return F.when(blank(text_col), F.lit(reply))


def enhance_question(c, keywords: Sequence[str] = L.DOMAIN_KEYWORDS_17,
                     prefix: str = L.DOMAIN_PREFIX) -> Column:
    """Prefix a context phrase unless a domain keyword occurs in the question."""
    c = col_(c)
    return F.when(contains_any(F.lower(c), keywords), c).otherwise(F.concat(F.lit(prefix), c))


def classify(c, patterns: Mapping[str, Sequence[str]] = L.QUERY_PATTERNS,
             default: str = "general") -> Column:
    """First class (declared order) with a pattern inside the lower-cased question."""
    low = F.lower(col_(c))
    expr = None
    for cls, pats in patterns.items():
        cond = contains_any(low, pats)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def extract_terms(c, synonyms: Mapping[str, Sequence[str]] = L.DOMAIN_SYNONYMS,
                  extra: Sequence[str] = L.EXTRA_DOMAIN_WORDS) -> Column:
    """Heads found directly or through a synonym, plus extra words; de-duplicated, sorted."""
    low = F.lower(col_(c))
    found = [F.when(contains_any(low, [h, *syns]), F.lit(h)) for h, syns in synonyms.items()]
    found += [F.when(low.contains(w), F.lit(w)) for w in extra]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def context_hints(type_col, hints: Mapping[str, Sequence[str]] = L.CONTEXT_HINTS) -> Column:
    """E5: fixed hint words for a class, empty for the others."""
    t = col_(type_col)
    expr = None
    for cls, hs in hints.items():
        arr = F.array(*[F.lit(h) for h in hs])
        expr = F.when(t == cls, arr) if expr is None else expr.when(t == cls, arr)
    return expr.otherwise(F.array().cast("array<string>"))


def question_confidence(c, terms_col) -> Column:
    """``min(0.5 + min(0.1 n_terms, 0.3) + length_boost, 1)``; words = ``split()`` tokens."""
    wc = word_count(c)
    term_boost = F.least(F.size(col_(terms_col)) * F.lit(0.1), F.lit(0.3))
    length_boost = F.when((wc >= 5) & (wc <= 20), F.lit(0.2)).otherwise(
        F.greatest(F.lit(0.0), F.lit(0.2) - F.abs(wc - F.lit(12)) * F.lit(0.01)))
    return F.least(F.lit(0.5) + term_boost + length_boost, F.lit(1.0))


def analyze_questions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """E7 (+E8): type, expanded text (identity), hints, domain terms, confidence."""
    x = df.withColumn("query_type", classify(text_col))
    x = x.withColumn("expanded_query", F.col(text_col))
    x = x.withColumn("retail_terms", extract_terms(text_col))
    x = x.withColumn("context_hints", context_hints("query_type"))
    return x.withColumn("confidence", question_confidence(text_col, "retail_terms"))


def expand_questions(df: DataFrame, lexicon: dict[str, Sequence[str]] | None = None, text_col: str = "text",
                     out: str = "expanded_query") -> DataFrame:
    """The question followed by the synonyms of the lexicon heads it contains.

    Without a lexicon the question stays as it is, which is what the request
    flow uses.  Synonyms already in the question are not repeated.
    """
    text = F.col(text_col)
    if not lexicon:
        return df.withColumn(out, text)
    low = F.lower(text)
    added = [F.when(low.contains(head) & ~low.contains(s), F.lit(s)) for head, syn in lexicon.items() for s in syn]
    extra = F.array_join(F.array_distinct(F.array_compact(F.array(*added))), " ")
    return df.withColumn(out, F.when(extra == "", text).otherwise(F.concat(text, F.lit(" "), extra)))


def question_report(analyzed: DataFrame) -> DataFrame:
    """Counts and mean confidence per (class, term) with class subtotals and a total (rollup)."""
    ex = analyzed.select("query_type", "confidence",
                         F.explode_outer("retail_terms").alias("term"))
    return (ex.rollup("query_type", "term")
              .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"),
                   F.grouping_id().alias("level")))


def question_words(c) -> Column:
    return words(F.lower(py_strip(c)))
