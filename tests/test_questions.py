"""Question-analysis semantics, including the substring / order quirks that are part of the contract."""
from pyspark.sql import functions as F

from sift.operators import questions as Q


def analyze(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return Q.analyze_questions(df).first()


def test_substring_without_word_boundaries(spark):
    r = analyze(spark, "What is our strategy?")
    assert "price" in r.retail_terms           # "rate" inside "strategy"
    assert r.query_type == "definition"


def test_uppercase_pattern_never_matches(spark):
    assert analyze(spark, "Can I get a refund").query_type == "general"   # "can I get" vs lower-cased text


def test_declared_order_shadows(spark):
    assert analyze(spark, "Is it available in stock?").query_type == "product_lookup"   # before availability
    assert analyze(spark, "What is the process to return").query_type == "how_to"     # before definition
    assert analyze(spark, "How to compare two brands").query_type == "comparison"      # comparison before how_to


def test_hints_and_confidence(spark):
    r = analyze(spark, "How to measure customer sales in a store")
    assert r.query_type == "how_to"
    assert r.context_hints == ["process", "steps", "implementation", "strategy"]
    # terms: customer, sales, store (+ "shop"? no) -> 3 terms -> +0.3; 9 words -> +0.2
    assert set(r.retail_terms) >= {"customer", "sales", "store"}
    assert r.confidence == 1.0


def test_confidence_length_penalty(spark):
    r = analyze(spark, "hi")
    assert abs(r.confidence - (0.5 + (0.2 - 11 * 0.01))) < 1e-12   # one word: |1 - 12| * 0.01 off the 0.2


def test_blank_questions(spark):
    df = spark.createDataFrame([(" 　\n",), ("ok",), (None,)], "text string")
    assert Q.non_blank(df, "text").count() == 1
