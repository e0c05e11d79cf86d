"""Turning a text column into unit vectors.

The default embedder is feature hashing: every lower-cased word token (split by
a SQL expression) goes to bucket ``md5(token)[0:8] as hex mod dim``, a
document's vector is its bucket counts scaled to unit length.  The vector is
local to its row, so it is counted in the Arrow batch that holds the row and
nothing is shuffled.

A model embedder plugs in as an Arrow batch function (``embed_with``): the
model is loaded once per Python worker and sees whole Arrow batches.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, word_tokens, words
from ..session import ship_package

DEFAULT_DIM = 64


def _bucket_counts(n_ids: int, dim: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            toks = rb.column(n_ids)
            n = rb.num_rows
            size = np.asarray(toks.value_lengths().fill_null(0)).astype(np.int64)
            enc = toks.flatten().dictionary_encode()
            bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in enc.dictionary.to_pylist()], np.int64)
            m = np.zeros((n, dim))
            if len(bucket):
                cell = np.repeat(np.arange(n), size) * dim + bucket[np.asarray(enc.indices)]
                m = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*rb.columns[:n_ids], arr], names=[*rb.schema.names[:n_ids], out])
    return run


def hash_embed(df: DataFrame, id_cols: Sequence[str] | str, text_col: str = "text",
               dim: int = DEFAULT_DIM, out: str = "embedding", max_tokens: int | None = None) -> DataFrame:
    """C1 (+C2): ``(ids..., out ARRAY<DOUBLE>)``, one row per input row, unit length,
    zeros for token-free text.  ``max_tokens`` keeps the first tokens only (C4).  No shuffle."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    ship_package(df.sparkSession)
    text = F.col(text_col) if max_tokens is None else truncate_tokens(text_col, max_tokens)
    src = df.select(*ids, word_tokens(text).alias("_toks"))
    schema = T.StructType(src.schema.fields[:-1] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    return src.mapInArrow(_bucket_counts(len(ids), dim, out), schema)


def truncate_tokens(c, n: int = 256) -> Column:
    """C4: keep the first ``n`` whitespace tokens (word tokens stand in for model tokens)."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def embed_distinct(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM,
                   out: str = "embedding") -> DataFrame:
    """Embed each distinct text once and join the vectors back on the text.

    Texts are told apart by their SHA-256, so the join key stays narrow.
    """
    keyed = df.withColumn("_tkey", F.sha2(F.col(text_col), 256))
    uniq = keyed.select("_tkey", text_col).dropDuplicates(["_tkey"])
    vecs = hash_embed(uniq, ["_tkey"], text_col, dim, out)
    return keyed.join(vecs, "_tkey", "left").drop("_tkey")


def embed_with(df: DataFrame, text_col: str, embedder: Callable[[list[str]], np.ndarray],
               dim: int, out: str = "embedding") -> DataFrame:
    """C1 model hook: ``embedder(list_of_texts) -> (n, dim) array`` applied per Arrow batch.

    Vectors are L2-normalised on the way out.  Columns other than ``out`` pass through.
    """
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [t or "" for t in rb.column(text_col).to_pylist()]
            m = np.asarray(embedder(texts), dtype=np.float64).reshape(len(texts), dim)
            nrm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, nrm, out=np.zeros_like(m), where=nrm > 0)
            arr = pa.array(list(m), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [arr],
                                             names=list(rb.schema.names) + [out])

    return df.mapInArrow(run, schema)
