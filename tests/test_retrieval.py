"""Vector retrieval against brute force; MMR and LSH properties; blocked query sets."""
import numpy as np
from pyspark.sql import functions as F

from sift.operators.retrieval import ann_search, mmr, recall_at_k, semantic_search

SF = "/root/testdata/sf0.001"


def _vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    corp = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    qs = e.filter(F.col("vec_id") % 7 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return e, corp, qs


def _brute(corp_rows, q_rows, k, metric):
    ids = np.array([r.chunk_id for r in corp_rows])
    V = np.array([r.embedding for r in corp_rows], dtype=np.float64)
    out = {}
    for q in q_rows:
        x = np.array(q.embedding, dtype=np.float64)
        if metric == "cosine":
            d = 1 - V @ x / (np.linalg.norm(V, axis=1) * np.linalg.norm(x))
        else:
            d = ((V - x) ** 2).sum(axis=1)
        order = np.lexsort((ids, np.round(d, 9)))[:k]
        out[q.qid] = list(ids[order])
    return out


def test_semantic_matches_brute_force(spark):
    _, corp, qs = _vectors(spark)
    for metric in ("cosine", "l2"):
        got = semantic_search(qs, corp, 5, metric).collect()
        want = _brute(corp.collect(), qs.collect(), 5, metric)
        g = {}
        for r in sorted(got, key=lambda r: (r.qid, r.rank)):
            g.setdefault(r.qid, []).append(r.chunk_id)
        assert g == want


def test_blocked_query_sets_give_same_answer(spark):
    _, corp, qs = _vectors(spark)
    a = {(r.qid, r.chunk_id, r.rank) for r in semantic_search(qs, corp, 3).collect()}
    b = {(r.qid, r.chunk_id, r.rank) for r in semantic_search(qs, corp, 3, query_block=7).collect()}
    assert a == b


def test_mmr_lambda_one_is_plain_topk(spark):
    _, corp, qs = _vectors(spark)
    m = mmr(qs, corp, k=4, fetch_k=8, lam=1.0, metric="cosine").collect()
    s = semantic_search(qs, corp, 4, "cosine").collect()
    assert {(r.qid, r.chunk_id, r.pick) for r in m} == {(r.qid, r.chunk_id, r.rank) for r in s}


def test_lsh_recall(spark):
    _, corp, qs = _vectors(spark)
    approx = ann_search(qs, corp, 5)
    exact = semantic_search(qs, corp, 5, "l2")
    rec = recall_at_k(approx, exact).agg(F.avg("recall")).first()[0]
    assert rec >= 0.8


def test_vocabulary_from_small_summaries_is_exact(spark):
    """Summaries that lose terms, a recount, and counters too few to prove anything (they are doubled)."""
    from sift.operators import lexical as lx
    from sift.plans.inputs import line_chunks
    chunks = line_chunks(spark, SF).repartition(5).cache()
    full = lx.term_stats(chunks, "content").where("term IS NOT NULL").orderBy(F.desc("cf"), "term").limit(40).collect()
    want = [(r.term, r.cf, r.df) for r in full]
    seen = []
    keep = lx._summaries
    try:
        def watch(counters, stop):
            seen.append(counters)
            return keep(counters, stop)
        lx._summaries = watch
        for counters in (10 ** 6, 4000, 60):
            n, got = lx.frequent_terms(chunks, "content", 40, counters=counters)
            assert n == chunks.count() and got == want, counters
    finally:
        lx._summaries = keep
    assert seen[:2] == [10 ** 6, 4000] and seen[2] == 60 and len(seen) > 3
    part = next(iter(lx._summaries(60, lx.STOP_WORDS)([])))
    assert part.num_rows == 1  # a task without rows sends its totals alone


def test_queries_filter_the_terms_that_are_shuffled(spark):
    from sift.operators import lexical as lx
    from sift.plans.inputs import bench_queries, line_chunks
    chunks, q = line_chunks(spark, SF), bench_queries(spark, SF)
    one = lambda names: lambda code, tf, length, row: tf * 1.0
    asked = lx.term_vectors(q, "qid", "text", one)
    terms = {t for r in asked.collect() for t in r.terms}
    cut = lx.term_vectors(chunks, "chunk_id", "content", one, asked=lx.term_filter(asked)).collect()
    whole = {r.chunk_id: dict(zip(r.terms, r.weights)) for r in lx.term_vectors(chunks, "chunk_id", "content", one).collect()}
    kept = {r.chunk_id: dict(zip(r.terms, r.weights)) for r in cut}
    assert all(kept)
    for c, own in whole.items():
        mine = {t: w for t, w in own.items() if t in terms}
        assert mine.items() <= kept.get(c, {}).items()
    assert sum(map(len, kept.values())) < 1.02 * sum(len([t for t in own if t in terms]) for own in whole.values()) + 20
