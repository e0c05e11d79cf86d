"""Operator 6: quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure exceeds a cutoff.  For every stratum
(language) and rule the labelled holdout tells how many good documents a
candidate cutoff would reject; the exact (Clopper-Pearson) upper bound of that
rate must stay within the rule's share of ``risk``.  Multiple testing: the error
is split over the rules (Bonferroni); within a rule the cutoffs are tested from
the mildest on and testing ends at the first that fails (fixed sequence).  The
last that passed is used; a rule without one is off in that stratum.

Defined results: null text is empty (no words, hence base_failed); a null
stratum is the stratum ''; repeated rows are judged alike; without labels only
the base rules act; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .evidence import label_rows, label_sample, learn_terms, term_scores
from .flow import Stage, join_stats, null_safe
from .measures import measures

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: rules and their candidate cutoffs, lowest (most aggressive) first
RULES = {
    "symbols": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "dup_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeats": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3],
    "upper": [0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "marks": [0.05, 0.1, 0.2, 0.5, 1.0],
    "sameness": [0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
    "terms": [0.0, 1.0, 2.0, 4.0],
}
RISK, CONFIDENCE, MAX_LABELS = 0.05, 0.95, 40_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _beta_tail(k: float, n: float, p: float) -> float:
    """P(X <= k) of a binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p
    if x <= 0 or x >= 1:
        return float(x >= 1)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            f *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return 1 - front * f if flip else front * f


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact upper confidence bound of a rate of which ``k`` of ``n`` were seen."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_tail(k, n, mid) > error else (lo, mid)
    return hi


def choose(counts: list[tuple[str, str, int, int, int]], risk: float = RISK, confidence: float = CONFIDENCE) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule from (stratum, rule, candidate number, good documents over it, good documents)."""
    out: dict[str, dict[str, float]] = {}
    for s in {c[0] for c in counts}:
        own = [c for c in counts if c[0] == s]
        error = (1 - confidence) / len(RULES)
        for rule, cuts in RULES.items():
            for _, _, k, over, n in sorted((c for c in own if c[1] == rule), key=lambda c: -c[2]):
                if upper_bound(over, n, error) > risk / len(RULES):
                    break
                out.setdefault(s, {})[rule] = cuts[k]
    return out


def least_rows(risk: float = RISK, confidence: float = CONFIDENCE) -> int:
    """Good documents that certify a cutoff which rejects none of them; fewer certify nothing."""
    return max(1, math.floor(math.log((1 - confidence) / len(RULES)) / math.log1p(-risk / len(RULES))))


def _certified(risk: float, confidence: float):
    """Rejection counts of a stratum -> (_stratum, _cuts in the order of the rules)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = row["_stratum"]
                cut = choose([(s, rule, k, row[f"{rule}_{k}"], row["n"]) for rule in RULES for k in range(len(RULES[rule]))], risk, confidence)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.string()), pa.array([[cut.get(s, {}).get(r) for r in RULES]], pa.list_(pa.float64()))], ["_stratum", "_cuts"])
    return run


def _rates(m: dict[str, np.ndarray], hits: np.ndarray) -> dict[str, np.ndarray]:
    w, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    return {"symbols": m["n_symbols"] / w, "dup_lines": m["n_dup_lines"] / lines, "repeats": m["n_repeat_words"] / w,
            "upper": m["n_upper"] / np.maximum(m["n_letters"], 1), "marks": m["n_marks"] / w, "sameness": 1 - m["n_distinct"] / w, "terms": hits}


def _measured(terms):
    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(2))
            for i, j in tk.slices(off):
                own = tk.cut(data, off, i, j)
                m = measures(*own)
                r = np.stack(list(_rates(m, term_scores(*own, terms)[0]).values()), axis=1).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *[pa.array(m[c]) for c in COUNTS],
                     tk.list_array(r.ravel(), np.arange(0, r.size + 1, len(RULES)))], ["doc_id", "_stratum", *COUNTS, "_rates"])
    return run


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                  risk: float = RISK, confidence: float = CONFIDENCE, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, counts, base_failed, kept, failed_rules) for every document.

    ``kept``: not base_failed and no certified rule of its stratum broken.
    Word evidence for the ``terms`` rule comes from one half of a sample of at
    most ``max_labels`` labelled ids; the good documents of all other labelled
    ids are the holdout that certifies all cutoffs, in every stratum that has
    ``least_rows`` of them.
    """
    st = Stage(docs.sparkSession, "rules")
    src = docs.select(F.col(id_col).alias("doc_id"), null_safe(F.col(stratum_col).cast("string")).alias("_stratum"), F.col(text_col).cast("string").alias("_text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, _stratum string, {', '.join(f'{c} long' for c in COUNTS)}, _rates array<double>"
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    learn = label_sample(labels, max_labels).withColumn("fold", fold).where("fold = 0")  # bounded, so it is broadcast
    terms = learn_terms(src.join(F.broadcast(learn), "doc_id").select(F.col("_text").alias("text"), F.col("_toxic").alias("flag"), "fold"))[0]
    measured = st.keep(src.mapInArrow(_measured(terms), schema), "measured")
    holdout = label_rows(labels).where("_quality = 1 AND _toxic = 0").join(F.broadcast(learn.select("doc_id")), "doc_id", "left_anti").select("doc_id")
    names = list(RULES)
    seen = (measured.where(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words").join(holdout, "doc_id").groupBy("_stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("_rates")[r] > c).cast("long")).alias(f"{names[r]}_{k}") for r in range(len(names)) for k, c in enumerate(RULES[names[r]])])
        .where(F.col("n") >= least_rows(risk, confidence)))
    cuts = seen.mapInArrow(_certified(risk, confidence), "_stratum string, _cuts array<double>")
    strata = st.keep(measured.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows")).join(cuts, "_stratum", "left"), "strata")
    rows = strata.agg(F.sum("_rows")).first()[0] or 0
    judged = join_stats(measured, strata, "_stratum", "_rows", rows)
    broken = F.concat_ws(",", *[F.when(F.col("_rates")[r] > F.col("_cuts")[r], F.lit(names[r])) for r in range(len(names))])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = st.hold(judged.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & (broken == "")).alias("kept"), broken.alias("failed_rules")))
    st.drop(*list(st.paths))
    return out
