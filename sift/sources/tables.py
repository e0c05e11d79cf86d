"""Parquet table access for the test-data layout (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Tables whose rows carry long text: the per-row work (splitting, tokenising)
# is CPU-heavy, so they are spread over all cores when read as few splits.
TEXT_TABLES = {"documents", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that was read as fewer than two splits per core.

    A file with one row group is read by one task however many cores there
    are.  Such an input is small relative to the cluster (fewer splits than
    cores means less than ~2 x cores x maxPartitionBytes), so a round-robin
    repartition is cheap; a large input already has enough splits and is left
    as read — no extra shuffle at scale.
    """
    p = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * p) if df.rdd.getNumPartitions() < 2 * p else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df
