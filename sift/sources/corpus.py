"""Text corpus scan, collection sinks and scans, message log.

The "collection" is a Parquet table with one row per chunk (id, text,
metadata columns, embedding).  Writes are plain DataFrame writes; the
get-or-create and upsert behaviours are write modes and a left-anti join.
"""

from __future__ import annotations

from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import ship_package
from .encodings import decode

SOURCE_BUCKETS = 64


def read_corpus(spark: SparkSession, path: str, glob: str = "*.txt",
                fallback: str = "ISO-8859-1") -> DataFrame:
    """A1: every matching file under ``path`` (recursive) as one document.

    ``(source, text, n_bytes, encoding)``.  Plain UTF-8 is decoded by Spark;
    files with zero bytes, a byte-order mark or bytes that are not UTF-8 go to
    the detector (``encodings.detect``), ``fallback`` being its last resort.
    """
    ship_package(spark)
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).load(path))
    as_text = F.col("content").cast("string")
    plain = F.is_valid_utf8(as_text) & ~as_text.contains("\u0000") & ~as_text.startswith("\ufeff")

    @F.pandas_udf("text string, encoding string")
    def detected(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if c is None else decode(bytes(c), fallback) for c in content], columns=["text", "encoding"])

    files = raw.select(F.col("path").alias("source"), "content", plain.alias("_plain"), F.col("length").alias("n_bytes"))
    files = files.withColumn("_d", detected(F.when(~F.col("_plain"), F.col("content"))))
    return files.select("source", F.when(F.col("_plain"), F.decode("content", "UTF-8")).otherwise(F.col("_d.text")).alias("text"), "n_bytes",
                        F.when(F.col("_plain"), F.lit("utf-8")).otherwise(F.col("_d.encoding")).alias("encoding"))


def file_inventory(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """A2 inventory: files under ``path`` by extension (content is never read).

    ``parts``: a file is what Spark wrote into one folder, in however many part files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    if parts:
        whole = raw.select(ext.alias("ext"), F.regexp_replace("path", "/[^/]*$", "").alias("path"), "length")
        raw = whole.groupBy("ext", "path").agg(F.sum("length").alias("length"))
        ext = F.col("ext")
    return (raw.select(ext.alias("ext"), "length").groupBy("ext")
               .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")))


class EmptyCorpusError(RuntimeError):
    pass


def require_corpus(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A2 guard: an empty corpus is an error that names the files that are there."""
    if docs.isEmpty():
        inv = ""
        if path is not None:
            try:
                rows = file_inventory(docs.sparkSession, path).collect()   # one row per extension
                inv = ", ".join(f"{r['ext'] or '(none)'}: {r['files']}" for r in rows)
            except AnalysisException:
                inv = "path not found"
        raise EmptyCorpusError(f"no documents found{(' under ' + path) if path else ''}"
                               f"{(' (present: ' + inv + ')') if inv else ''}")
    return docs


def _with_bucket(df: DataFrame, source_col: str) -> DataFrame:
    return df.withColumn("source_bucket", F.pmod(F.xxhash64(source_col), F.lit(SOURCE_BUCKETS)))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Order-independent content fingerprint: (row count, sum of 64-bit row hashes).

    One aggregate with partial aggregation; only two numbers reach the driver.
    """
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.col(c) for c in cols])
    r = df.select(F.count(F.lit(1)).alias("n"),
                  F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return int(r["n"]), int(r["s"] or 0)


def save_collection(df: DataFrame, path: str, mode: str = "ignore", source_col: str = "source") -> bool:
    """A3: ``ignore`` keeps an existing collection untouched (get-or-create);
    ``refresh`` rewrites it; ``auto`` rewrites only when the content changed
    (fingerprint of the incoming rows vs the stored one), so the collection
    cannot go stale.  Partitioned by a hash bucket of the source.  Returns
    whether anything was written."""
    if mode not in ("ignore", "refresh", "auto"):
        raise ValueError("mode is 'ignore', 'refresh' or 'auto'")
    spark = df.sparkSession
    if mode == "auto":
        if _exists(spark, path):
            stored = spark.read.parquet(path).select(*df.columns)
            if fingerprint(stored) == fingerprint(df):
                return False
        mode = "refresh"
    if mode == "ignore" and _exists(spark, path):
        return False
    out = _with_bucket(df, source_col) if source_col in df.columns else df
    w = out.write.mode("ignore" if mode == "ignore" else "overwrite")
    if "source_bucket" in out.columns:
        w = w.partitionBy("source_bucket")
    w.parquet(path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at ``path``; errors other than absence are raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def new_rows(df: DataFrame, existing: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """A4 core: rows whose key is not in ``existing`` (left-anti join)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(existing.select(*keys), keys, "left_anti")


def append_new(df: DataFrame, path: str, key: str = "chunk_id", source_col: str = "source") -> int:
    """A4: add only rows with ids not yet in the collection, each id once; returns how many were added.

    In a collection bucketed by source the stored ids are matched within the
    bucket, so only the buckets of the new rows are read.
    """
    spark = df.sparkSession
    todo = df.dropDuplicates([key])
    bucketed = source_col in todo.columns
    if bucketed:
        todo = _with_bucket(todo, source_col)
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        if bucketed and "source_bucket" in stored.columns:
            hit = [r[0] for r in todo.select("source_bucket").distinct().collect()]  # at most SOURCE_BUCKETS numbers
            stored = stored.where(F.col("source_bucket").isin(hit))
        todo = new_rows(todo, stored, key)
    seen = Observation()
    w = todo.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
    if bucketed:
        w = w.partitionBy("source_bucket")
    w.parquet(path)
    return int(seen.get["n"])


def load_collection(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A5: read the collection back; only the named columns are read (pruned at the scan)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def append_messages(messages: DataFrame, path: str) -> None:
    """A6 sink: append (session_id, turn, role, content) rows, partitioned by session bucket."""
    out = messages.withColumn("session_bucket", F.pmod(F.xxhash64("session_id"), F.lit(SOURCE_BUCKETS)))
    out.write.mode("append").partitionBy("session_bucket").parquet(path)


def clear_session(log: DataFrame, session_id, session_col: str = "session_id") -> DataFrame:
    """A6 clear: the log without one session (its page history and its bot history)."""
    return log.filter(~F.col(session_col).eqNullSafe(F.lit(session_id)))
