"""Operator 9: best-fit packing planned on the histogram of piece lengths.

Documents are tokenised once; a longer one is cut into full pieces (its first
piece takes the remainder).  Best-fit decreasing then runs over the counts of
the (at most ``seq_len``) lengths: a group of equal sequences with the same
free space is one entry, so the plan's size depends on ``seq_len`` and not on
the number of documents.  Pieces take the planned places by joining on their
rank within their length.

Defined results: null text is empty (one piece, the end id alone); repeated
rows are packed as often as they occur; an empty table gives no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import BpeCounter
from .flow import Stage, rank_within

SEQ_LEN = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over length counts.

    Entries (length, rank_lo, rank_hi, sequence_lo, each, offset): the pieces of
    that length with ranks rank_lo..rank_hi-1 go to sequence ``sequence_lo +
    (rank - rank_lo) // each`` at ``offset + (rank - rank_lo) % each * length``.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    free: list[tuple[int, int, int]] = []  # (free space, first sequence, sequences), sorted
    opened = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect.bisect_left(free, (length, -1, -1))
            if i < len(free):
                space, first, n = free.pop(i)
            else:
                space, first, n = seq_len, opened, -(-left // (seq_len // length))
                opened += n
            each = space // length
            used = min(n, left // each)
            if used:  # sequences that take as many as fit
                out.append((length, rank, rank + used * each, first, each, seq_len - space))
                rank, left = rank + used * each, left - used * each
                if space - each * length:
                    bisect.insort(free, (space - each * length, first, used))
            if left and used < n:  # one more takes the rest
                out.append((length, rank, rank + left, first + used, left, seq_len - space))
                bisect.insort(free, (space - left * length, first + used, 1))
                used, left = used + 1, 0
            if used < n:
                bisect.insort(free, (space, first + used, n - used))
    return out


def _pieces(seq_len: int, path: str | None):
    def run(batches):
        counter = BpeCounter(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, parts in counter.pieces(batch.column(1), seq_len):
                row, piece, start, length, crc = parts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i + r] for r in row.tolist()], pa.int64()), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text",
         vocabulary: str | None = None) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark: SparkSession = docs.sparkSession
    st = Stage(spark, "packing")
    pieces = st.hold(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                     .mapInArrow(_pieces(seq_len, vocabulary), PIECES))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most seq_len rows
    entries = spark.createDataFrame(plan(counts, seq_len), "length long, lo long, hi long, first long, each long, base long")
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank", 64)
    k = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(entries), "length").where("rank >= lo AND rank < hi")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("base") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset")))
