"""Response-time flagging and report over a request log.

All aggregates are mergeable (count, sum, min, max), so a hot event type is
pre-aggregated inside each task.  ``latency_percentiles`` is a mergeable
sketch; ``exact_percentiles`` sorts only the values near each percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOW_SECONDS = 30.0      # fixed value: above this a response is "slow"


def latency_flag(value, threshold: float = SLOW_SECONDS) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v > F.lit(threshold), F.lit("slow")).otherwise(F.lit("acceptable"))


def latency_report(events: DataFrame, value_col: str = "value", by: str = "event_type",
                   threshold: float = SLOW_SECONDS) -> DataFrame:
    v = F.col(value_col)
    return events.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(v > F.lit(threshold)).alias("slow"),
        F.avg(v).alias("mean_seconds"),
        F.min(v).alias("min_seconds"),
        F.max(v).alias("max_seconds"),
        (F.count_if(v > F.lit(threshold)) / F.count(F.lit(1))).alias("slow_share"))


def latency_percentiles(events: DataFrame, value_col: str = "value", by: str = "event_type",
                        accuracy: int = 10000) -> DataFrame:
    return events.groupBy(by).agg(
        F.percentile_approx(value_col, [0.5, 0.9, 0.99], accuracy).alias("p50_p90_p99"))


def exact_percentiles(events: DataFrame, value_col: str = "value", by: str = "event_type",
                      shares: tuple[float, ...] = (0.5, 0.9, 0.99), accuracy: int = 10000) -> DataFrame:
    """(by, percentiles): the smallest value with at least a share of the values at or below it.

    A sketch brackets each percentile by twice its error; counts by distinct
    value give the rank of the bracket, and only values within it are sorted."""
    e = events.select(F.col(by).alias("_by"), F.col(value_col).alias("_v"))
    wide = 2.0 / accuracy
    ends = [max(0.0, q - wide) for q in shares] + [min(1.0, q + wide) for q in shares]
    b = e.groupBy("_by").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_ends"))
    counts = e.where("_v IS NOT NULL").groupBy("_by", "_v").agg(F.count(F.lit(1)).alias("_c"))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_ends")[i].alias("lo"), F.col("_ends")[i + len(shares)].alias("hi"),
                                  F.greatest(F.lit(1), F.col("_n") - F.floor(F.col("_n") - F.lit(q) * F.col("_n"))).alias("rank"))
                         for i, q in enumerate(shares)])
    near = counts.join(b.select(F.col("_by").alias("_k"), brackets.alias("_b")), F.col("_by").eqNullSafe(F.col("_k"))).select(
        "_by", "_v", "_c", F.explode("_b").alias("b")).select("_by", "_v", "_c", "b.*").where("_v <= hi")
    near = near.groupBy("_by", "i", "rank", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c"))
    up = Window.partitionBy("_by", "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    got = near.withColumn("_up", F.sum("_c").over(up)).where("_v IS NOT NULL AND _up >= rank").groupBy("_by").agg(
        *[F.min(F.when(F.col("i") == i, F.col("_v"))).alias(f"_p{i}") for i in range(len(shares))])
    out = b.select("_by").join(got.withColumnRenamed("_by", "_k"), F.col("_by").eqNullSafe(F.col("_k")), "left")
    return out.select(F.col("_by").alias(by), F.array(*[F.col(f"_p{i}") for i in range(len(shares))]).alias("percentiles"))
