"""Turning a document table into a chunk table.

* B1 ``chunk_documents`` — recursive separator splitting with greedy merge and
  overlap.  The per-document string walk is Python (``mapInArrow``; one
  document -> several rows), everything around it is DataFrame code.
* B2 ``split_chunks`` / B3 ``window_chunks`` — SQL-only chunkers
  (``posexplode`` of a split / of a ``sequence`` of window starts).
* B5 ``with_chunk_ids`` — a stable global running index without a single
  ordered task: per-document counts, range-partitioned prefix sums, broadcast
  of the ranges' offsets (one row per partition).
* B6 ``enrich_chunks``, B7 ``group_similar``, B8 ``corpus_stats``.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.vectors import cosine_similarity
from ..session import shared_dir, ship_package


# --------------------------------------------------------------------------- B1

def _split_keep(text: str, sep: str) -> list[str]:
    """Split on ``sep`` keeping it at the start of the following piece; no empties."""
    if sep == "":
        return [c for c in text]
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int, length=len) -> list[str]:
    out: list[str] = []
    cur: list[str] = []
    total = 0
    for p in pieces:
        n = length(p)
        if total + n > size and cur:
            joined = "".join(cur).strip()
            if joined:
                out.append(joined)
            while total > overlap or (total + n > size and total > 0):
                total -= length(cur[0])
                cur = cur[1:]
        cur.append(p)
        total += n
    joined = "".join(cur).strip()
    if joined:
        out.append(joined)
    return out


def split_text(text: str, size: int, overlap: int, separators: Sequence[str], length=len) -> list[str]:
    """Recursive splitting of one text (the per-row helper of B1); ``length`` measures a piece."""
    sep = separators[-1]
    deeper: list[str] = []
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep = s
            deeper = list(separators[i + 1:])
            break
    chunks: list[str] = []
    small: list[str] = []
    for piece in _split_keep(text, sep):
        if length(piece) < size:
            small.append(piece)
            continue
        if small:
            chunks.extend(_merge(small, size, overlap, length))
            small = []
        if not deeper:
            chunks.append(piece)
        else:
            chunks.extend(split_text(piece, size, overlap, deeper, length))
    if small:
        chunks.extend(_merge(small, size, overlap, length))
    return chunks


def start_indexes(text: str, chunks: list[str], overlap: int, length=len) -> list[int]:
    """Each chunk's place, searched from ``overlap`` before the previous end (the whole previous chunk when length is not in characters)."""
    idx, prev_len, out = 0, 0, []
    for c in chunks:
        idx = text.find(c, max(0, idx + prev_len - overlap) if length is len else max(0, idx + min(1, prev_len)))
        prev_len = len(c)
        out.append(idx)
    return out


OUT_ROWS = 5000     # chunks per output batch


def chunk_documents(docs: DataFrame, size: int, overlap: int, separators: Sequence[str],
                    id_col: str = "doc_id", text_col: str = "text",
                    keep: Sequence[str] = ("source",), length_fn: Callable[[str], int] = len) -> DataFrame:
    """B1 (+B4): ``(id, keep..., chunk_no, start_index, chunk_length, content)``.

    ``size`` and ``overlap`` are measured by ``length_fn`` (characters by
    default); ``chunk_length`` is in characters.  Every document is processed
    whole.  Output rows are generated in the task that read the document, a few
    thousand chunks at a time: no shuffle.
    """
    ship_package(docs.sparkSession)
    keep = [c for c in keep if c in docs.columns and c != id_col]
    src = docs.select(id_col, *keep, text_col)
    id_type = dict(src.dtypes)[id_col]
    keep_ddl = "".join(f", {c} {t}" for c, t in src.dtypes if c in keep)
    schema = (f"{id_col} {id_type}{keep_ddl}, chunk_no int, start_index int, "
              f"chunk_length int, content string")
    seps = tuple(separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            arrow = _arrow_schema(rb.schema, id_col, keep)
            rows: list[int] = []
            out = {n: [] for n in ["chunk_no", "start_index", "chunk_length", "content"]}

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                cols = [rb.column(n).take(at) for n in [id_col, *keep]]
                cols += [pa.array(out[n], arrow.field(n).type) for n in out]
                return pa.RecordBatch.from_arrays(cols, schema=arrow)

            for i, text in enumerate(rb.column(text_col)):
                text = text.as_py() or ""
                pieces = split_text(text, size, overlap, seps, length_fn)
                for j, (p, s) in enumerate(zip(pieces, start_indexes(text, pieces, overlap, length_fn))):
                    rows.append(i)
                    for n, v in zip(out, (j, s, len(p), p)):
                        out[n].append(v)
                if len(rows) >= OUT_ROWS:
                    yield flush()
                    rows = []
                    out = {n: [] for n in out}
            yield flush()

    return src.mapInArrow(run, schema)


def _arrow_schema(in_schema: pa.Schema, id_col: str, keep: Sequence[str]) -> pa.Schema:
    fields = [in_schema.field(id_col)] + [in_schema.field(c) for c in keep]
    fields += [pa.field("chunk_no", pa.int32()), pa.field("start_index", pa.int32()),
               pa.field("chunk_length", pa.int32()), pa.field("content", pa.string())]
    return pa.schema(fields)


# --------------------------------------------------------------------------- B2 / B3

def row_key(a, b) -> Column:
    """Key of row ``b`` of parent ``a`` (both integers): fixed-width text, so it is
    unique for all values and sorts by (a, b) where they are not negative."""
    return F.format_string("%020d:%010d", F.col(a).cast("long"), F.col(b).cast("long"))


def split_chunks(docs: DataFrame, sep: str = "\n", id_col: str = "doc_id", text_col: str = "text",
                 keep: Sequence[str] = ("source",)) -> DataFrame:
    """B2: one row per non-blank piece of ``split(text, sep)`` with its position.

    ``chunk_id`` is ``row_key(doc_id, chunk_no)`` (the id as text and the number
    for ids that are not integers).
    """
    keep = [c for c in keep if c in docs.columns and c != id_col]
    x = docs.select(id_col, *keep, F.posexplode(F.split(F.col(text_col), re.escape(sep), -1))
                    .alias("chunk_no", "_piece"))
    x = x.withColumn("content", py_strip("_piece")).filter(F.length("content") > 0)
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    key = row_key(id_col, "chunk_no") if whole else F.format_string("%s:%010d", F.col(id_col), F.col("chunk_no"))
    return x.select(key.alias("chunk_id"), id_col, *keep, "chunk_no", "content")


def window_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """B3 (+B4): substrings of ``size`` chars at stride ``size - overlap``.

    A window starting inside the previous window's overlap tail would add no
    new text and is not emitted.  ``start_index`` is 0-based.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.length(F.col(text_col))
    starts = F.sequence(F.lit(0), F.greatest(n - F.lit(overlap + 1), F.lit(0)), F.lit(step))
    x = docs.select(id_col, text_col, F.posexplode(starts).alias("chunk_no", "start_index"))
    x = x.withColumn("content", F.substring(F.col(text_col), F.col("start_index") + 1, size).cast("string"))
    x = x.select(id_col, "chunk_no", "start_index", "content").filter(F.length("content") > 0)
    return x.withColumn("chunk_length", F.length("content"))


# --------------------------------------------------------------------------- B5

def with_chunk_ids(chunks: DataFrame, prefix: str = "doc_", doc_col: str = "doc_id",
                   pos_col: str = "chunk_no", parts: int | None = None) -> DataFrame:
    """``chunk_index`` = global running index in (doc, position) order and
    ``chunk_key = prefix || chunk_index``.

    Exact and stable for keys of any sortable type; no single ordered task.
    Documents (with their chunk counts) are range-partitioned by key, each range
    has its own running sum, and the ranges' totals (one row per partition) are
    prefix-summed and broadcast.
    """
    spark = chunks.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(n, doc_col).withColumn("_b", F.spark_partition_id())
    shared_dir(spark)
    ranged = ranged.checkpoint()  # range borders are sampled: fix them before they are used twice
    within = F.sum("_n").over(Window.partitionBy("_b").orderBy(doc_col).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    totals = ranged.groupBy("_b").agg(F.sum("_n").alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    doc_off = ranged.withColumn("_w", within).join(F.broadcast(before), "_b").select(doc_col, (F.col("_o") + F.col("_w")).alias("_doff"))
    local = F.row_number().over(Window.partitionBy(doc_col).orderBy(pos_col)) - 1
    out = chunks.withColumn("_local", local).join(doc_off, doc_col)
    out = out.withColumn("chunk_index", (F.col("_doff") + F.col("_local")).cast("long"))
    return out.withColumn("chunk_key", F.concat(F.lit(prefix), F.col("chunk_index").cast("string"))
                          ).drop("_local", "_doff")


# --------------------------------------------------------------------------- B6 / B7 / B8

def enrich_chunks(chunks: DataFrame, ts: str = "2024-01-01 00:00:00",
                  content_col: str = "content") -> DataFrame:
    """chunk_length and a processing timestamp (a parameter, so runs repeat)."""
    return (chunks.withColumn("chunk_length", F.length(content_col))
                  .withColumn("processing_timestamp", F.to_timestamp(F.lit(ts))))


def group_similar(chunks: DataFrame, tau: float, doc_col: str = "doc_id", pos_col: str = "chunk_no",
                  vec_col: str = "embedding", content_col: str = "content") -> DataFrame:
    """Merge adjacent chunks of a document while cosine(prev, cur) >= tau.

    Gaps-and-islands: a chunk starts a new group unless it is similar enough
    to its predecessor (compared at 1e-9 resolution, so summation order cannot
    flip an exact tie); the group number is the running count of starts.
    """
    w = Window.partitionBy(doc_col).orderBy(pos_col)
    prev = F.lag(vec_col).over(w)
    x = chunks.withColumn("_start", F.when(prev.isNull(), 1)
                          .when(F.round(cosine_similarity(prev, F.col(vec_col)), 9) >= F.lit(tau), 0)
                          .otherwise(1))
    x = x.withColumn("group_no", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = x.groupBy(doc_col, "group_no").agg(
        F.min(pos_col).alias("first_chunk"), F.count(F.lit(1)).alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(content_col).alias("c"))))
        .alias("_parts"))
    return g.select(doc_col, "group_no", "first_chunk", "n_chunks",
                    F.array_join(F.transform("_parts", lambda s: s["c"]), "\n").alias("content"))


def corpus_stats(docs: DataFrame, chunks: DataFrame, doc_col: str = "doc_id",
                 group_col: str = "source", content_col: str = "content") -> DataFrame:
    """Documents, chunks and chunk lengths per source plus a grand total row (rollup)."""
    per_doc = chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_c"),
                                          F.sum(F.length(content_col)).alias("_l"))
    d = docs.select(doc_col, group_col).join(per_doc, doc_col, "left")
    return (d.rollup(group_col)
             .agg(F.count(F.lit(1)).alias("documents"),
                  F.coalesce(F.sum("_c"), F.lit(0)).alias("chunks"),
                  F.coalesce(F.sum("_l"), F.lit(0)).alias("chunk_chars"),
                  (F.sum("_l") / F.sum("_c")).alias("avg_chunk_length"),
                  F.grouping(group_col).alias("is_total")))
