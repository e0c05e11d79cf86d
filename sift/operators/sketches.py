"""J1 and H9 as stored sketches: written per hour, combined later for any span of time.

A sketch table holds one row per hour and group; a report over a span merges
the sketches of its hours and reads nothing else.  Quantile sketches (KLL) of
``k`` items have a rank error of about ``2.3 / k**0.9`` with 99 percent confidence
whatever the number of values merged; top-k sketches track up to ``items``
words and are exact while no more different words were seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

KLL_K = 2000
TRACKED = 100_000


def _hour(time_col: str) -> Column:
    return F.date_trunc("hour", F.col(time_col).cast("timestamp")).alias("hour")


def rank_error(k: int = KLL_K) -> float:
    return 2.3 / k ** 0.9


def write_latency_sketches(events: DataFrame, path: str, time_col: str = "ts", by: str = "event_type", value_col: str = "value", k: int = KLL_K) -> None:
    """``(hour, by, n, sketch)``; partial sketches are made in each task and merged."""
    rows = events.where(F.col(value_col).isNotNull()).groupBy(_hour(time_col), by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(k)).alias("sketch"))
    rows.write.mode("append").parquet(path)


def latency_from_sketches(sketches: DataFrame, since=None, until=None, by: str = "event_type", shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``(by, n, p50, p90, p99)`` over the hours in ``[since, until)`` (timestamps; default: all)."""
    s = sketches if since is None else sketches.where(F.col("hour") >= F.lit(since))
    s = s if until is None else s.where(F.col("hour") < F.lit(until))
    merged = s.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(f"p{q * 100:g}") for q in shares])


def write_topic_sketches(turns: DataFrame, path: str, time_col: str, items: int = TRACKED) -> None:
    """``(hour, sketch)`` of the lower-cased words of user messages."""
    u = turns.where("role = 'user'").select(_hour(time_col), F.explode(words(F.lower(F.col("text")))).alias("word"))
    u.groupBy("hour").agg(F.expr(f"approx_top_k_accumulate(word, {int(items)})").alias("sketch")).write.mode("append").parquet(path)


def topics_from_sketches(sketches: DataFrame, k: int = 20, since=None, until=None, items: int = TRACKED) -> DataFrame:
    """``(word, cnt)``: the ``k`` most frequent words (ties: word) over the hours in ``[since, until)``."""
    s = sketches if since is None else sketches.where(F.col("hour") >= F.lit(since))
    s = s if until is None else s.where(F.col("hour") < F.lit(until))
    merged = s.agg(F.expr(f"approx_top_k_combine(sketch, {int(items)})").alias("_s"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {int(items)})")).alias("x"))
    return top.select(F.col("x.item").alias("word"), F.col("x.count").alias("cnt")).orderBy(F.desc("cnt"), "word").limit(k)
