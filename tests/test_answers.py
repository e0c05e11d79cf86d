"""Answer cleaning and validation goldens (hand-derived)."""
from pyspark.sql import functions as F

from sift.functions import lexicons as L
from sift.operators import answers as A


def _clean(spark, text, profile, key=1):
    df = spark.createDataFrame([(key, text)], "k long, answer string")
    return A.clean_answers(df, "answer", profile, key="k").first().cleaned


def test_prefix_sequential_vs_first(spark):
    t = "Answer:  Response: the shop opens at nine."
    assert _clean(spark, t, "orca") == "the shop opens at nine."
    assert _clean(spark, t, "fast") == "Response: the shop opens at nine."


def test_empty_and_whitespace(spark):
    assert _clean(spark, "", "orca") == L.EMPTY_MSG["orca"]
    assert _clean(spark, None, "improved") == L.EMPTY_MSG["improved"]
    assert _clean(spark, "   ", "improved") == L.TRUNCATED_EMPTY_MSG["improved"]
    assert _clean(spark, "ok\nxy", "orca") == L.NO_LINES_MSG["orca"]


def test_sentence_truncation(spark):
    s = ("Sentence number %d is here. " * 40) % tuple(range(40))
    out = _clean(spark, s, "fast")
    assert len(out) <= 500 and out.endswith(".") and out.startswith("Sentence number 0")
    words = "w" * 600
    assert _clean(spark, words, "flan") == words[:497] + "..."


def test_confidence_float_trap(spark):
    # 0.5 + 0.2 - 0.2 in doubles is just below 0.5 -> "Low confidence" is reported
    ans = "This might be the answer you need for your question about the store."
    df = spark.createDataFrame([(ans, "store question", 5)], "answer string, question string, n_sources int")
    r = A.validate_answers(df).first()
    assert r.confidence_score < 0.5
    assert r.issues == ["Low confidence"]


def test_clarity_counts_trailing_piece(spark):
    df = spark.createDataFrame([("one two three.", )], "a string")
    # pieces: "one two three", "" -> 3 words / 2 pieces = 1.5 -> no boost
    assert df.select(A.answer_clarity("a")).first()[0] == 0.5


def test_lines_are_lowered_once(spark):
    from sift.operators.answers import filter_lines
    skip = ["source:", "file:", "context:"]
    df = spark.createDataFrame([("Keep this\n  SOURCE: x\nabc\n\nFile: y\nlast one  ",), (None,)], "t string")
    one = filter_lines("t", skip)
    assert [r[0] for r in df.select(one).collect()] == [["Keep this", "last one"], None]
    plan = df.select(one.alias("lines"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1
