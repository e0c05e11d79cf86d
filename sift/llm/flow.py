"""Spark helpers shared by the operators: staged tables, ranks, skew-safe joins, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sift.session import scratch_path, shared_dir, ship_package

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_MB = 4


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small: a batch (and a task's memory) must not grow with document length."""
    shared_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if "".join(c for c in spark.conf.get(key) if c.isdigit()) not in (str(BATCH_MB << 20),):
        spark.conf.set(key, f"{BATCH_MB << 20}b")


class Stage:
    """Intermediate tables of one operator call, written as Parquet to the shared checkpoint folder.

    ``keep`` writes a table and rereads it: its lineage ends there and its
    shuffle files are released.  ``drop`` deletes tables that later ones have
    fully read.  What a returned, still lazy DataFrame reads goes through
    ``hold`` (``DataFrame.checkpoint``), which Spark's cleaner removes once
    nothing refers to it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}
        prepare(spark)

    def keep(self, df: DataFrame, part: str) -> DataFrame:
        conf = self.spark.conf
        old, path = conf.get(_CLEANUP, "false"), scratch_path(self.spark, f"{self.name}-{part}")
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, old)
        self.paths[part] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def hold(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()

    def drop(self, *parts: str) -> None:
        for part in parts:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(part))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """``out``: 0-based gapless rank of each row within its key, without one task per key.

    Rows of a key are dealt to ``buckets`` hash buckets of the order columns;
    a row's rank is its place in the bucket plus the rows of the earlier
    buckets.  The offsets table (keys x buckets rows at most) is broadcast, so
    the number of distinct keys must be bounded by the caller.  ``order``
    should identify a row; rows equal in it are interchangeable.
    """
    cols = df.columns
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(*keys, "_b", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_o"))
    ranked = b.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    return ranked.join(F.broadcast(first), [*keys, "_b"]).select(*cols, (F.col("_o") + F.col("_r") - 1).cast("long").alias(out))


#: A key with at least 1 / HEAVY of all rows is heavy; at most HEAVY keys are.
HEAVY = 2000


def join_stats(df: DataFrame, stats: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """Left join of per-key statistics (unique ``key``; ``count`` = rows of the key) to rows, safe under skew.

    Keys with at least ``rows / HEAVY`` rows are at most ``HEAVY`` whatever the
    input, so they are broadcast; the others are joined by a shuffle in which
    no key has more than that share.
    """
    at = max(1, -(-rows // HEAVY))
    heavy = F.broadcast(stats.where(F.col(count) >= at).limit(HEAVY))
    light = stats.where(F.col(count) < at)
    hot = df.join(heavy, key)
    rest = df.join(F.broadcast(stats.where(F.col(count) >= at).select(key).limit(HEAVY)), key, "left_anti")
    return hot.unionByName(rest.join(light, key, "left").select(*hot.columns))


def _forest(batches):
    """Edges of one partition replaced by stars of its local components (union-find)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        node = np.fromiter(parent, np.int64, len(parent))
        root = np.fromiter((find(int(x)) for x in node), np.int64, len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["v", "m"])


def components(st: Stage, edges: DataFrame, a: str, b: str, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges: (v, m), m the smallest id of v's component, for v > m only.

    Partitions first contract their own edges, then alternating large-star and
    small-star rounds run until every component is a star; each round is a
    written table.  Star centres are join keys with a hot side that AQE splits.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
    schema = "v long, m long"
    cur = st.keep(e.mapInArrow(_forest, schema).distinct(), f"{tag}0")
    for i in range(1, 60):
        deep = cur.join(cur.select(F.col("v").alias("m")).distinct(), "m", "left_semi").limit(1).count()
        wide = 0 if deep else cur.groupBy("v").count().where("count > 1").limit(1).count()
        if not deep and not wide:
            return cur
        both = cur.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(cur.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("x"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("x").alias("m")).where("v != m").distinct()
        small = large.groupBy("v").agg(F.min("m").alias("x"))
        nxt = large.join(small, "v").select(F.col("m").alias("v"), F.col("x").alias("m")).where("v != m").unionByName(small.withColumnRenamed("x", "m"))
        new = st.keep(nxt.mapInArrow(_forest, schema).distinct(), f"{tag}{i}")
        st.drop(f"{tag}{i - 1}")
        cur = new
    raise RuntimeError("components did not converge")


def null_safe(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))

