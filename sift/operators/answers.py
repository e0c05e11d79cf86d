"""F1-F10 answer cleaning and G1-G7 answer validation, as column expressions.

Each cleaning step is one ``withColumn`` so a step's result is computed once
and referenced by name (Catalyst does not inline a non-trivial expression
that is used several times).  Nothing here leaves the JVM.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import WS, col_, contains_any, py_strip, starts_with_any, words

_REGEX_SPECIAL = set(".^$*+?()[]{}|\\")


def regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in s)


def prefix_strip_sequential_re(prefixes: Sequence[str]) -> str:
    """F2 as one anchored regex: every prefix tried once, in order, case-insensitive."""
    return "(?i)\\A" + "".join(f"(?:{regex_quote(p)}{WS}*)?" for p in prefixes)


def prefix_strip_first_re(prefixes: Sequence[str]) -> str:
    """the first matching prefix only."""
    return "(?i)\\A(?:" + "|".join(regex_quote(p) for p in prefixes) + f"){WS}*"


SENTENCES_RE = "(?s)^(.*\\. )"


def is_empty(c) -> Column:
    """F1 test: Python falsiness of the raw value (NULL or '')."""
    return F.coalesce(col_(c), F.lit("")) == ""


def strip_prefixes(c, prefixes: Sequence[str], sequential: bool = True) -> Column:
    rx = prefix_strip_sequential_re(prefixes) if sequential else prefix_strip_first_re(prefixes)
    return F.regexp_replace(col_(c), rx, "")


def remove_phrases(c, phrases: Sequence[str]) -> Column:
    """drop every occurrence (case-sensitive), stripping after each phrase."""
    out = col_(c)
    for p in phrases:
        out = py_strip(F.replace(out, F.lit(p), F.lit("")))
    return out


def filter_lines(c, skip: Sequence[str]) -> Column:
    """F5 (array form): stripped lines longer than 3 chars without a skip pattern (lower-cased)."""
    lines = F.transform(F.split(col_(c), "\n", -1), lambda l: py_strip(l))
    lines = F.transform(F.filter(lines, lambda l: F.length(l) > 3), lambda l: F.struct(l.alias("line"), F.lower(l).alias("low")))  # lowered once
    return F.transform(F.filter(lines, lambda l: ~contains_any(l["low"], skip)), lambda l: l["line"])


def sentence_prefix(c, window: int) -> Column:
    """the text up to the last '. ' that ends inside the first ``window`` chars ('' if none)."""
    return F.regexp_extract(F.substring(col_(c), 1, window), SENTENCES_RE, 1)


def opener_pick(key, openers: Sequence[str] = L.OPENERS) -> Column:
    """deterministic choice of an opener from a row key (md5 bucket)."""
    idx = F.conv(F.substring(F.md5(col_(key).cast("string")), 1, 8), 16, 10).cast("long") % F.lit(len(openers))
    return F.element_at(F.array(*[F.lit(o) for o in openers]), (idx + 1).cast("int"))


def add_opener(c, key, checks: Sequence[str] = L.OPENER_CHECKS, openers: Sequence[str] = L.OPENERS) -> Column:
    c = col_(c)
    pick = opener_pick(key, openers)
    return F.when(starts_with_any(F.lower(c), checks) | (pick == ""), c).otherwise(
        F.concat(pick, F.lit(" "), c))


def clean_answers(df: DataFrame, col: str, profile: str, key: str | None = None,
                  out: str = "cleaned") -> DataFrame:
    """F1-F9 in the order of the chosen profile.  ``key`` seeds the F9 opener (advanced)."""
    x = df.withColumn("_raw", F.col(col))
    if profile == "fast":
        x = x.withColumn("_s", py_strip("_raw"))
        x = x.withColumn("_p", strip_prefixes("_s", L.PREFIXES_FAST, sequential=False))
        x = x.withColumn("_t", F.when(F.length("_p") > 500, py_strip(sentence_prefix("_p", 500)))
                         .otherwise(F.col("_p")))
        res = (F.when(is_empty("_s"), F.lit(L.EMPTY_MSG["fast"]))
               .when(F.col("_t") == "", F.lit(L.TRUNCATED_EMPTY_MSG["fast"])).otherwise(F.col("_t")))
    elif profile == "improved":
        x = x.withColumn("_p", strip_prefixes(py_strip("_raw"), L.PREFIXES_IMPROVED, sequential=False))
        x = x.withColumn("_t", F.when(F.length("_p") > 1500, py_strip(sentence_prefix("_p", 1502)))
                         .otherwise(F.col("_p")))
        res = (F.when(is_empty("_raw"), F.lit(L.EMPTY_MSG["improved"]))
               .when(F.col("_t") == "", F.lit(L.TRUNCATED_EMPTY_MSG["improved"])).otherwise(F.col("_t")))
    elif profile in ("flan", "orca", "advanced"):
        prefixes = {"flan": L.PREFIXES_FLAN, "orca": L.PREFIXES_ORCA, "advanced": L.PREFIXES_ADVANCED}[profile]
        skip = {"flan": L.SKIP_LINES_FLAN, "orca": L.SKIP_LINES_ORCA, "advanced": L.SKIP_LINES_ADVANCED}[profile]
        limit = {"flan": 500, "orca": 2500, "advanced": 2000}[profile]
        x = x.withColumn("_p", strip_prefixes(py_strip("_raw"), prefixes))
        if profile == "flan":
            x = x.withColumn("_p", remove_phrases("_p", L.REMOVE_PHRASES_FLAN))
        if profile == "advanced":
            x = x.withColumn("_p", add_opener("_p", key or col))
        x = x.withColumn("_lines", filter_lines("_p", skip))
        x = x.withColumn("_c", F.array_join("_lines", " " if profile == "flan" else "\n"))
        x = x.withColumn("_f", sentence_prefix("_c", limit))
        if profile == "flan":
            cut = F.when(F.col("_f") != "", py_strip("_f")).otherwise(
                F.concat(F.substring("_c", 1, limit - 3), F.lit("...")))
        else:
            cut = F.when(F.length("_f") > 100, py_strip("_f")).otherwise(
                F.concat(F.substring("_c", 1, limit - 3), F.lit("...")))
        res = (F.when(is_empty("_raw"), F.lit(L.EMPTY_MSG[profile]))
               .when(F.size("_lines") == 0, F.lit(L.NO_LINES_MSG[profile]))
               .when(F.length("_c") > limit, cut).otherwise(F.col("_c")))
    else:
        raise ValueError(f"unknown profile {profile}")
    x = x.withColumn(out, res)
    return x.drop(*[c for c in ("_raw", "_s", "_p", "_t", "_lines", "_c", "_f") if c in x.columns])


def substitute_failures(answer, failed, profile: str = "advanced") -> Column:
    """a failed generation becomes the profile's fixed apology."""
    return F.when(col_(failed), F.lit(L.APOLOGY[profile])).otherwise(col_(answer))


# --------------------------------------------------------------------------- G

def answer_confidence(r) -> Column:
    """G1: 0.5, +0.2 for 50..1000 chars, +0.1 specific words, -0.2 uncertain words, clamp."""
    r = col_(r)
    low = F.lower(r)
    n = F.length(r)
    s = F.lit(0.5) + F.when((n >= 50) & (n <= 1000), F.lit(0.2)).otherwise(F.lit(0.0))
    s = s + F.when(contains_any(low, L.SPECIFIC_WORDS), F.lit(0.1)).otherwise(F.lit(0.0))
    s = s - F.when(contains_any(low, L.UNCERTAIN_WORDS), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def answer_relevance(r, q, n_sources) -> Column:
    """0.5 + min(|Q∩R| / |Q|, 0.3) when they share a token, +0.2 with sources; clamp."""
    qt = F.array_distinct(words(F.lower(col_(q))))
    rt = F.array_distinct(words(F.lower(col_(r))))
    ov = F.size(F.array_intersect(qt, rt))
    s = F.lit(0.5) + F.when(ov > 0, F.least(ov / F.size(qt), F.lit(0.3))).otherwise(F.lit(0.0))
    s = s + F.when(col_(n_sources) > 0, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def answer_completeness(r) -> Column:
    """0.5, +0.3 for >= 100 chars, +0.2 with a structure mark (case-sensitive); clamp."""
    r = col_(r)
    s = F.lit(0.5) + F.when(F.length(r) >= 100, F.lit(0.3)).otherwise(F.lit(0.0))
    s = s + F.when(contains_any(r, L.STRUCTURE_MARKS), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def answer_clarity(r) -> Column:
    """0.5, +0.3 if mean words per '.'-piece is in [10, 25], +0.2 with a connector; clamp."""
    r = col_(r)
    pieces = F.split(r, "\\.", -1)
    total = F.aggregate(F.transform(pieces, lambda p: F.size(words(p))), F.lit(0), lambda a, b: a + b)
    avg = total / F.greatest(F.size(pieces), F.lit(1))
    s = F.lit(0.5) + F.when((avg >= 10) & (avg <= 25), F.lit(0.3)).otherwise(F.lit(0.0))
    s = s + F.when(contains_any(F.lower(r), L.CONNECTORS), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def validate_answers(df: DataFrame, answer_col: str = "answer", question_col: str = "question",
                     n_sources_col: str = "n_sources") -> DataFrame:
    """Four scores, overall, verdict and the issue list."""
    x = (df.withColumn("confidence_score", answer_confidence(answer_col))
           .withColumn("relevance_score", answer_relevance(answer_col, question_col, n_sources_col))
           .withColumn("completeness_score", answer_completeness(answer_col))
           .withColumn("clarity_score", answer_clarity(answer_col)))
    overall = (F.col("confidence_score") * F.lit(0.3) + F.col("relevance_score") * F.lit(0.3)
               + F.col("completeness_score") * F.lit(0.2) + F.col("clarity_score") * F.lit(0.2))
    x = x.withColumn("overall_quality", overall)
    x = x.withColumn("validation_passed", F.col("overall_quality") >= F.lit(0.6))
    names = ["confidence_score", "relevance_score", "completeness_score", "clarity_score"]
    issues = F.array(*[F.when(F.col(n) < F.lit(0.5), F.lit(lbl)) for n, lbl in zip(names, L.ISSUE_LABELS)])
    return x.withColumn("issues", F.array_compact(issues))


def quality_report(validated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Averages, pass rate and issue counts (per group, or one row)."""
    g = validated.groupBy(*by) if by else validated.groupBy()
    aggs = [F.count(F.lit(1)).alias("answers")]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in
             ("confidence_score", "relevance_score", "completeness_score", "clarity_score", "overall_quality")]
    aggs += [(F.count_if("validation_passed") / F.count(F.lit(1))).alias("pass_rate")]
    aggs += [F.count_if(F.array_contains("issues", lbl)).alias("n_" + lbl.lower().replace(" ", "_"))
             for lbl in L.ISSUE_LABELS]
    return g.agg(*aggs)
