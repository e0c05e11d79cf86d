"""C3 as a stored cache: every text is embedded once, across calls and sessions.

The cache is a table of (text_key, embedding) bucketed by the SHA-256 of the
text.  ``fill`` embeds the distinct texts that an anti join does not find in it
and appends them; ``lookup`` joins the vectors back.  The cached side is read
bucket by bucket and never shuffled; only the keys that are asked for are.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding import DEFAULT_DIM, hash_embed

BUCKETS = 64


class EmbeddingCache:
    """``name``: a table of the session's catalog whose files lie under ``path`` (made if absent, found again later)."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (text_key STRING, embedding ARRAY<DOUBLE>) USING parquet "
                  f"CLUSTERED BY (text_key) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def _keyed(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("text_key", F.sha2(F.col(text_col), 256))

    def fill(self, df: DataFrame, text_col: str = "text", embed: Callable[[DataFrame], DataFrame] | None = None, dim: int = DEFAULT_DIM) -> int:
        """Embed the texts not yet in the cache, each once; returns how many were.

        ``embed(texts) -> (text_key, embedding)`` of a table (text_key, text); default: feature hashing.
        A text embedded twice by writers at the same time is harmless (``lookup`` reads one).
        """
        texts = self._keyed(df.where(F.col(text_col).isNotNull()), text_col).groupBy("text_key").agg(F.first(text_col).alias("text"))
        new = texts.join(self.spark.table(self.name).select("text_key"), "text_key", "left_anti")
        vectors = embed(new) if embed else hash_embed(new, "text_key", "text", dim)
        before = self.spark.table(self.name).count()  # from the files' footers
        rows = vectors.select("text_key", F.col("embedding").cast("array<double>").alias("embedding"))
        rows.repartition(self.buckets, "text_key").write.insertInto(self.name)  # a file per bucket
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).count() - before

    def vectors(self) -> DataFrame:
        return self.spark.table(self.name).groupBy("text_key").agg(F.first("embedding").alias("embedding"))

    def lookup(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        """``df`` with the cached vector of each text (null where there is none)."""
        return self._keyed(df, text_col).join(self.vectors().withColumnRenamed("embedding", out), "text_key", "left").drop("text_key")

    def embed(self, df: DataFrame, text_col: str = "text", out: str = "embedding", **kw) -> DataFrame:
        """``fill`` and ``lookup``."""
        self.fill(df, text_col, **kw)
        return self.lookup(df, text_col, out)

    def drop(self) -> None:
        """Forget the table (its files stay under ``path``)."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
