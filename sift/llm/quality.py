"""Operator 1: quality classifier by hierarchical empirical Bayes.

A document classifier (ridge logistic regression on binned shape measures and
learned word evidence, fitted on at most ``max_labels`` labelled ids, one row
of each) gives
each document its own evidence.  Soft counts of good documents are then summed
by host and by path over the whole table; sparse sites shrink toward the level
above with strengths estimated from the data (method of moments).  A document's
posterior adds its site's log-odds, without its own count, to its own.

Defined results: null text is empty; a null host or path is the site ''; rows
repeated in ``docs`` count as often as they occur; without labelled rows of
both classes the evidence is neutral (p 0.5) and all documents are kept; an
empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .evidence import label_sample, learn_terms, term_scores
from .flow import join_stats, null_safe, prepare
from .measures import measures, shape

MAX_LABELS = 20_000
BINS = 12


def _inputs(data: np.ndarray, off: np.ndarray, terms) -> np.ndarray:
    hits, weight = term_scores(data, off, terms)
    return np.column_stack([shape(measures(data, off)), np.log1p(hits), np.log1p(weight)])


def _train_rows(terms_of_fold):
    """Measures of the labelled sample; each fold uses the terms learned from the other."""
    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(0))
            flags, folds = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for i, j in tk.slices(off):
                own = tk.cut(data, off, i, j)
                x = np.where((folds[i:j] == 0)[:, None], _inputs(*own, terms_of_fold[1]), _inputs(*own, terms_of_fold[0]))
                yield pa.RecordBatch.from_arrays([pa.array(flags[i:j].astype(np.int32)), tk.list_array(x.ravel(), np.arange(0, x.size + 1, x.shape[1]))], ["good", "x"])
    return run


class Evidence:
    """Additive model: one weight per bin of each measure, fitted by ridge-penalised Newton steps."""

    def __init__(self, x: np.ndarray, good: np.ndarray, ridge: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        z = self._design(x)
        beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (good - p) - penalty * beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def _design(self, x: np.ndarray) -> np.ndarray:
        cols = [np.ones((len(x), 1))]
        for c, e in zip(x.T, self.edges):
            cols.append((np.searchsorted(e, c, "left")[:, None] == np.arange(len(e) + 1)[None, :]).astype(float))
        return np.hstack(cols)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labels: int) -> tuple[Evidence | None, tuple]:
    sample = label_sample(labels, max_labels)  # bounded, so it is broadcast
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "_quality", "_toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row an id, however often it occurs
            .select("text", "_quality", "_toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")))
    terms = learn_terms(rows.select("text", F.col("_toxic").alias("flag"), "fold"))
    good = ((F.col("_quality") == 1) & (F.col("_toxic") == 0)).cast("int")
    got = rows.select("text", good.alias("good"), "fold").mapInArrow(_train_rows(terms), "good int, x array<double>").toPandas()  # at most max_labels rows
    y = got["good"].to_numpy(float) if len(got) else np.zeros(0)
    if len(y) == 0 or y.min() == y.max():
        return None, terms[None]
    return Evidence(np.stack(got["x"].to_list()), y), terms[None]


def _scorer(model: Evidence | None, terms, at: int):
    """Append the log-odds of the text (column ``at``, dropped) to each row."""
    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(at))
            odds = np.zeros(batch.num_rows)
            if model is not None:
                for i, j in tk.slices(off):
                    odds[i:j] = model.log_odds(_inputs(*tk.cut(data, off, i, j), terms))
            cols = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(odds)], [*names, "_odds"])
    return run


def _strength(stats: DataFrame, rate: str, above: str, n: str) -> float:
    """Beta prior strength by the method of moments over the groups of ``stats``."""
    q = stats.agg(F.sum(F.col(n) * F.pow(F.col(rate) - F.col(above), 2)).alias("between"), F.sum(n).alias("n"),
                  F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"), F.count(F.lit(1)).alias("k"),
                  (F.sum(F.col(n) * F.col(above) * (1 - F.col(above))) / F.sum(n)).alias("spread")).first()
    if not q["n"] or q["k"] < 2:
        return 1e6
    room = q["n"] - q["nn"] / q["n"]
    tau = max(0.0, (q["between"] - (q["k"] - 1) * q["spread"]) / room) if room > 0 else 0.0
    return min(1e6, max(1.0, q["spread"] / tau - 1)) if tau > 0 else 1e6


def classify_quality(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text",
                     host_col: str = "source", path_col: str = "lang", max_labels: int = MAX_LABELS) -> DataFrame:
    """``carry`` columns of every document plus host, path, p_document, p_host, p_path, p_good and kept.

    A site is ``host_col``; its path is ``path_col`` within it.  ``kept`` is
    true for a posterior of 0.5 or more.
    """
    prepare(docs.sparkSession)
    model, terms = fit(docs, labels, id_col, text_col, max_labels)
    own = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)]
    src = docs.select(*own, null_safe(F.col(host_col).cast("string")).alias("_host"), null_safe(F.col(path_col).cast("string")).alias("_path"),
                      F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([f for f in src.schema.fields if f.name != "_text"] + [T.StructField("_odds", T.DoubleType())])
    site = F.concat_ws("\u0001", "_host", "_path")

    def scored(frame: DataFrame) -> DataFrame:
        kept = T.StructType([f for f in schema.fields if f.name in [*frame.columns, "_odds"]])
        return (frame.mapInArrow(_scorer(model, terms, frame.columns.index("_text")), kept)
                .withColumn("_p", 1 / (1 + F.exp(-F.col("_odds")))).withColumn("_site", site))

    paths = (scored(src.select("_host", "_path", "_text")).groupBy("_site", "_host")
             .agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_s"))).persist()
    try:
        hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
        total = paths.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
        rows = total["n"] or 0
        mu = min(1 - 1e-6, max(1e-6, (total["s"] or 0.0) / max(rows, 1)))
        both = paths.join(hosts, "_host").withColumns({"_r": F.col("_s") / F.col("_n"), "_hr": F.col("_hs") / F.col("_hn")})
        k_host = _strength(hosts.withColumns({"_hr": F.col("_hs") / F.col("_hn"), "_mu": F.lit(mu)}), "_hr", "_mu", "_hn")
        k_path = _strength(both, "_r", "_hr", "_n")
        stats = both.select("_site", "_n", "_s", "_hn", "_hs").checkpoint()
    finally:
        paths.unpersist()
    out = join_stats(scored(src), stats, "_site", "_n", rows)
    host = (F.col("_hs") - F.col("_p") + k_host * mu) / (F.col("_hn") - 1 + k_host)
    out = out.withColumn("p_host", F.greatest(F.least(host, F.lit(1 - 1e-6)), F.lit(1e-6)))
    path = (F.col("_s") - F.col("_p") + k_path * F.col("p_host")) / (F.col("_n") - 1 + k_path)
    out = out.withColumn("p_path", F.greatest(F.least(path, F.lit(1 - 1e-6)), F.lit(1e-6)))
    posterior = F.col("_odds") + F.log(F.col("p_path") / (1 - F.col("p_path"))) - F.lit(math.log(mu / (1 - mu)))
    if model is None:
        posterior = F.lit(0.0)
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_p").alias("p_document"), "p_host", "p_path", (1 / (1 + F.exp(-posterior))).alias("p_good"), (posterior >= 0).alias("kept"))


