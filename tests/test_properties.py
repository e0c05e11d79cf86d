"""Property tests: bounded scores and lengths, model hooks."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sift.operators import answers as A
from sift.operators import hybrid as H
from sift.operators import prompts as P
from sift.operators.embedding import embed_with

LIMITS = {"fast": 500, "flan": 500, "orca": 2500, "advanced": 2000, "improved": 1502}
text_st = st.text(alphabet=st.sampled_from(list("ab. \nAnswer:xyz!?")), max_size=3000)


@settings(max_examples=25, deadline=None)
@given(st.lists(text_st, min_size=1, max_size=8))
def test_cleaned_answers_respect_limits(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, answer string")
    for prof, lim in LIMITS.items():
        out = A.clean_answers(df, "answer", prof, key="k").select("cleaned").collect()
        assert all(r.cleaned and len(r.cleaned) <= max(lim, 200) for r in out)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(text_st, text_st), min_size=1, max_size=8))
def test_validation_scores_bounded(spark, pairs):
    df = spark.createDataFrame([(a, q, 1) for a, q in pairs], "answer string, question string, n_sources int")
    for r in A.validate_answers(df).collect():
        for c in ("confidence_score", "relevance_score", "completeness_score", "clarity_score", "overall_quality"):
            assert 0.0 <= r[c] <= 1.0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 2), min_size=1, max_size=6), st.lists(st.floats(0.001, 1), min_size=0, max_size=6))
def test_hybrid_scores_bounded(spark, dists, scores):
    sem = spark.createDataFrame([(1, i, float(d), i + 1) for i, d in enumerate(dists)],
                                "qid long, chunk_id long, distance double, rank int")
    lex = spark.createDataFrame([(1, 100 + i, float(s), i + 1) for i, s in enumerate(scores)],
                                "qid long, chunk_id long, score double, rank int")
    content = spark.createDataFrame([(i, f"c{i}") for i in range(len(dists))] +
                                    [(100 + i, f"k{i}") for i in range(len(scores))], "chunk_id long, content string")
    out = H.hybrid_search(sem, lex, content, 20).collect()
    assert len(out) == len(dists) + len(scores)
    assert all(0.0 <= r.hybrid_score <= 1.0 and 0.0 <= r.confidence <= 1.0 for r in out)
    s = sorted(out, key=lambda r: r.rank)
    assert all(round(a.hybrid_score, 9) >= round(b.hybrid_score, 9) for a, b in zip(s, s[1:]))


def test_model_embedder_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "")], "id long, text string")
    out = {r.id: r.embedding for r in embed_with(df, "text", lambda ts: np.array([[len(t), 1.0] for t in ts]), 2).collect()}
    assert np.allclose(out[2], np.array([4, 1]) / np.sqrt(17))
    assert np.allclose(out[3], [0.0, 1.0])


def test_generate_hook(spark):
    qs = spark.createDataFrame([(1, "what is retail?")], "qid long, question string")
    chunks = spark.createDataFrame([(10, "Retail is selling.")], "chunk_id long, content string")
    retr = lambda q: q.select("qid", F.lit(10).cast("long").alias("chunk_id"), F.lit(1).alias("rank"))
    gen = lambda p: p.select("qid", F.concat(F.lit("Answer: "), F.length("prompt").cast("string")).alias("answer"))
    r = P.run_profile(qs, retr, chunks, None, None, lambda d: A.clean_answers(d, "answer", "fast"), None,
                      generate=gen).first()
    assert r.n_docs == 1 and "Retail is selling." in r.prompt and r.cleaned.isdigit()
