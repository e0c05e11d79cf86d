"""Lexicons as tables: the same answers as the column expressions, and ten thousand patterns."""
import tempfile

import pytest
from pyspark.sql import functions as F

from sift.functions import lexicons as L
from sift.operators import answers as A
from sift.operators import patterns as P
from sift.operators import questions as Q
from sift.plans.inputs import questions

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_tables_equal_column_expressions(spark):
    q = questions(spark, SF).unionByName(spark.createDataFrame([("n", None), ("e", ""), ("k", "How MUCH does the STOCK of İstanbul cost?")], "qid string, text string"))
    pats = spark.createDataFrame([(i, c, p) for i, (c, ps) in enumerate(L.QUERY_PATTERNS.items()) for p in ps], "priority int, query_type string, pattern string")
    assert rows(P.classify_by(q, "text", pats), "qid", "query_type") == rows(q.withColumn("t", F.coalesce(Q.classify("text"), F.lit("general"))), "qid", "t")
    lex = spark.createDataFrame([(h, s) for h, syn in L.DOMAIN_SYNONYMS.items() for s in syn] + [(w, w) for w in L.EXTRA_DOMAIN_WORDS], "head string, synonym string")
    want = rows(q.withColumn("t", F.coalesce(Q.extract_terms("text"), F.array().cast("array<string>"))), "qid", "t")
    assert rows(P.terms_by(q, "text", lex), "qid", "retail_terms") == want
    words = spark.createDataFrame([(w,) for w in L.UNCERTAIN_WORDS], "pattern string")
    from sift.functions.text import contains_any
    assert rows(P.contains_by(q, "text", words, "any"), "qid", "any") == rows(q.withColumn("any", F.coalesce(contains_any(F.lower("text"), L.UNCERTAIN_WORDS), F.lit(False))), "qid", "any")


def test_line_filter(spark):
    df = spark.createDataFrame([(1, " keep this \nSource: x\nok\n  longer line  "), (2, None), (3, "")], "id int, a string")
    skip = spark.createDataFrame([("source:",), (None,), ("",)], "pattern string")
    assert rows(P.filter_lines_by(df, "a", skip, "b"), "id", "b") == [(1, "keep this\nlonger line"), (2, ""), (3, "")]


def test_ten_thousand_patterns(spark):
    q = questions(spark, SF)
    lex = spark.range(10_000).select(F.concat(F.lit("q"), F.conv(F.col("id"), 10, 36)).alias("pattern"), F.col("id").alias("label"))
    hits = P.matched(q, F.lower("text"), lex.unionByName(spark.createDataFrame([("the", -1)], "pattern string, label long")), "labels")
    assert rows(hits.where(F.array_contains("labels", -1)), "qid") == rows(q.where(F.lower("text").contains("the")), "qid")
    with pytest.raises(P.LexiconTooLarge):
        P.LEXICON_BYTES, keep = 1000, P.LEXICON_BYTES
        try:
            P.matched(q, F.col("text"), lex)
        finally:
            P.LEXICON_BYTES = keep
    assert rows(P.matched(q, F.col("text"), lex.where("false")).where("size(labels) > 0"), "qid") == []


def test_embedding_cache(spark):
    from sift.operators.embed_cache import EmbeddingCache
    from sift.operators.embedding import embed_distinct
    df = spark.createDataFrame([(1, "red shoes"), (2, "red shoes"), (3, None), (4, ""), (5, "blue hat")], "id int, text string")
    cache = EmbeddingCache(spark, "emb_cache_test", tempfile.mkdtemp(prefix="sift-cache-") + "/c", 4)
    try:
        assert cache.fill(df.where("id < 3")) == 1
        assert cache.fill(df) == 2 and cache.fill(df) == 0  # the second run embeds nothing
        got = cache.lookup(df)
        assert rows(got.where("text IS NOT NULL"), "id", "embedding") == rows(embed_distinct(df.where("text IS NOT NULL")), "id", "embedding")
        assert got.where("text IS NULL").first().embedding is None
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = cache.lookup(df)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert plan.count("Exchange hashpartitioning(text_key") == 1 and "Bucketed: true" in plan  # the asked side only
        cache.drop()
        again = EmbeddingCache(spark, "emb_cache_test", cache.path, 4)  # a later session finds the files
        assert again.fill(df) == 0
    finally:
        cache.drop()
