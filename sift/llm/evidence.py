"""Word evidence learned from labelled documents, shared by the quality operators.

A feature is a word or the first five bytes of a longer one (lower-cased,
hashed).  Its counts over flagged and clean labelled documents are summed in
Spark; features that flagged documents hold far more often become the terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

PREFIX = 5
MIN_FLAGGED = 8      # flagged documents that hold a term, at least
MIN_RATIO = 20.0     # its rate in flagged over its rate in clean documents
MAX_TERMS = 5000     # of the highest weight (bounded model)


def label_rows(labels: DataFrame) -> DataFrame:
    """All labelled ids, one row each: the worst label of a repeated id holds."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(1))).cast("int").alias("_quality"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("_toxic"))


def label_sample(labels: DataFrame, max_labels: int) -> DataFrame:
    """At most ``max_labels`` rows of ``label_rows``, by hash order."""
    return label_rows(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word and word beginning."""
    start, end, doc = tk.words(data, off, tk.ALNUM_SEP)
    long = np.flatnonzero(end - start > PREFIX)
    whole = tk.span_hash(data, start, end, lower=True)
    head = ~tk.span_hash(data, start[long], start[long] + PREFIX, lower=True)
    return np.concatenate([whole, head]), np.concatenate([doc, doc[long]])


def _feature_counts(batches):
    """(text, flag, fold) rows -> (feature, fold, flagged, clean) document counts, summed over a slice."""
    for batch in batches:
        data, off = tk.text_bytes(batch.column(0))
        group = (2 * np.asarray(batch.column(2)) + np.asarray(batch.column(1))).astype(np.int64)
        for i, j in tk.slices(off):
            h, doc = word_features(*tk.cut(data, off, i, j))
            key = np.unique(np.rec.fromarrays([h, doc], names="h,d"))
            h, g = key["h"], group[i:j][key["d"]]
            u, back = np.unique(h, return_inverse=True)
            n = np.bincount(back * 4 + g, minlength=4 * len(u)).reshape(-1, 4)
            for fold in (0, 1):
                has = np.flatnonzero(n[:, 2 * fold:2 * fold + 2].any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tk.signed(u[has])), pa.array(np.full(len(has), fold, np.int32)),
                     pa.array(n[has, 2 * fold + 1]), pa.array(n[has, 2 * fold])], ["feature", "fold", "flagged", "clean"])


Terms = tuple[np.ndarray, np.ndarray]  # sorted feature hashes, weights


def learn_terms(labelled: DataFrame) -> dict[int | None, Terms]:
    """Terms from the rows (text, flag 0/1, fold 0/1): of each fold alone, and of both (None).

    Counts are grouped in Spark; what comes to the driver is at most
    ``3 * MAX_TERMS`` weighted features.
    """
    rows = labelled.select(F.col("text"), F.col("flag").cast("int"), F.col("fold").cast("int"))
    counts = rows.mapInArrow(_feature_counts, "feature long, fold int, flagged long, clean long")
    sizes = {(r["fold"], r["flag"]): r["n"] for r in rows.groupBy("fold", "flag").agg(F.count(F.lit(1)).alias("n")).collect()}
    by = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("flagged", "clean")])
    by = by.where(f"flagged0 + flagged1 >= {MIN_FLAGGED // 2}").persist()
    out: dict[int | None, Terms] = {}
    for fold in (0, 1, None):
        own = [fold] if fold is not None else [0, 1]
        nf = max(1, sum(sizes.get((f, 1), 0) for f in own))
        nc = max(1, sum(sizes.get((f, 0), 0) for f in own))
        flagged, clean = (sum((F.col(f"{c}{f}") for f in own[1:]), F.col(f"{c}{own[0]}")) for c in ("flagged", "clean"))
        weight = F.log((flagged + 0.5) / F.lit(nf + 1.0)) - F.log((clean + 0.5) / F.lit(nc + 1.0))
        least = MIN_FLAGGED if fold is None else MIN_FLAGGED // 2
        top = (by.where((flagged >= least) & (weight >= float(np.log(MIN_RATIO)))).select("feature", weight.alias("w"))
               .orderBy(F.desc("w"), "feature").limit(MAX_TERMS).collect())
        f = np.array([r["feature"] for r in top], np.int64).view(np.uint64)
        w = np.array([r["w"] for r in top], np.float64)
        by_hash = np.argsort(f)
        out[fold] = (f[by_hash], w[by_hash])
    by.unpersist()
    return out


def term_scores(data: np.ndarray, off: np.ndarray, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(number of term occurrences, their summed weight) of each document."""
    n = len(off) - 1
    if len(terms[0]) == 0:
        return np.zeros(n), np.zeros(n)
    h, doc = word_features(data, off)
    at = np.minimum(np.searchsorted(terms[0], h), len(terms[0]) - 1)
    hit = terms[0][at] == h
    return np.bincount(doc[hit], minlength=n).astype(float), np.bincount(doc[hit], weights=terms[1][at[hit]], minlength=n)
