"""Registered queries: question analytics (E), answer cleaning (F), answer validation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import blank, py_strip
from ..operators import answers as A
from ..operators import questions as Q
from ..operators.chunking import row_key
from ..operators.conversations import next_message
from . import duck as D
from .inputs import answers, answers_sql, questions, questions_sql
from .registry import register

_QS = questions_sql()
_AN = answers_sql()

# ------------------------------------------------------------------ E

_E1_SQL = f"""WITH {_QS}
SELECT qid, {D.strip('text')} AS question, length({D.strip('text')}) = 0 AS is_blank,
       CASE WHEN length({D.strip('text')}) = 0 THEN {D.lit(L.BLANK_REPLY)} END AS reply
FROM questions"""


@register("e1_non_blank", sql=_E1_SQL)
def e1_non_blank(spark, sf):
    q = questions(spark, sf)
    return q.select("qid", py_strip("text").alias("question"), blank("text").alias("is_blank"),
                    Q.blank_reply("text").alias("reply"))


# Questions with blanks: every third assistant-free turn is padded to white space, every fifth is null.
_QB = f"""{_QS}, qb AS (SELECT qid, CASE WHEN length(text) % 3 = 0 THEN '  ' || chr(10) WHEN length(text) % 5 = 0 THEN NULL ELSE text END AS text FROM questions)"""


def _with_blanks(spark, sf):
    n = F.length("text")
    return questions(spark, sf).withColumn("text", F.when(n % 3 == 0, F.lit("  \n")).when(n % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("text")))


@register("e1_non_blank_mixed", sql=f"WITH {_QB} SELECT qid, text FROM qb WHERE length({D.strip('coalesce(text, chr(32))')}) > 0")
def e1_non_blank_mixed(spark, sf):
    """The filter on questions of which a part is blank or null."""
    return Q.non_blank(_with_blanks(spark, sf)).select("qid", "text")


@register("e2_enhance_question", sql=f"""WITH {_QS}
SELECT qid, CASE WHEN {D.contains_any('lower(text)', L.DOMAIN_KEYWORDS_17)} THEN text
            ELSE {D.lit(L.DOMAIN_PREFIX)} || text END AS enhanced FROM questions""")
def e2_enhance_question(spark, sf):
    return questions(spark, sf).select("qid", Q.enhance_question("text").alias("enhanced"))


@register("e3_classify", sql=f"""WITH {_QS}
SELECT qid, {D.classify('text', L.QUERY_PATTERNS)} AS query_type FROM questions""")
def e3_classify(spark, sf):
    return questions(spark, sf).select("qid", Q.classify("text").alias("query_type"))


@register("e4_extract_terms", sql=f"""WITH {_QS}
SELECT qid, array_to_string({D.extract_terms('text', L.DOMAIN_SYNONYMS, L.EXTRA_DOMAIN_WORDS)}, '|') AS retail_terms
FROM questions""")
def e4_extract_terms(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(Q.extract_terms("text"), "|").alias("retail_terms"))


@register("e5_context_hints", sql=f"""WITH {_QS}, c AS (SELECT qid, {D.classify('text', L.QUERY_PATTERNS)} AS t FROM questions)
SELECT qid, t AS query_type, array_to_string({D.hints('t', L.CONTEXT_HINTS)}, '|') AS context_hints FROM c""")
def e5_context_hints(spark, sf):
    x = questions(spark, sf).select("qid", Q.classify("text").alias("query_type"))
    return x.select("qid", "query_type", F.array_join(Q.context_hints("query_type"), "|").alias("context_hints"))


_E7_CTE = f"""{_QS}, an AS (
  SELECT qid, text, {D.classify('text', L.QUERY_PATTERNS)} AS query_type,
         {D.extract_terms('text', L.DOMAIN_SYNONYMS, L.EXTRA_DOMAIN_WORDS)} AS terms FROM questions),
an2 AS (SELECT qid, text, query_type, terms, {D.hints('query_type', L.CONTEXT_HINTS)} AS hints,
               {D.question_confidence('text', 'terms')} AS confidence FROM an)"""


@register("e6_question_confidence", sql=f"""WITH {_E7_CTE}
SELECT qid, round(confidence, 6) AS confidence FROM an2""")
def e6_question_confidence(spark, sf):
    x = questions(spark, sf).withColumn("_t", Q.extract_terms("text"))
    return x.select("qid", F.round(Q.question_confidence("text", "_t"), 6).alias("confidence"))


@register("e7_analyze_questions", sql=f"""WITH {_E7_CTE}
SELECT qid, query_type, text AS expanded_query, array_to_string(hints, '|') AS context_hints,
       array_to_string(terms, '|') AS retail_terms, round(confidence, 6) AS confidence FROM an2""")
def e7_analyze_questions(spark, sf):
    a = Q.analyze_questions(questions(spark, sf))
    return a.select("qid", "query_type", "expanded_query",
                    F.array_join("context_hints", "|").alias("context_hints"),
                    F.array_join("retail_terms", "|").alias("retail_terms"),
                    F.round("confidence", 6).alias("confidence"))


@register("e9_question_report", sql=f"""WITH {_E7_CTE},
ex AS (SELECT query_type, confidence, unnest(CASE WHEN len(terms) = 0 THEN [NULL::VARCHAR] ELSE terms END) AS term FROM an2)
SELECT query_type, term, count(*) AS n, round(avg(confidence), 6) AS avg_confidence,
       grouping(query_type, term) AS level
FROM ex GROUP BY ROLLUP (query_type, term)""")
def e9_question_report(spark, sf):
    return Q.question_report(Q.analyze_questions(questions(spark, sf))).withColumn("avg_confidence", F.round("avg_confidence", 6))


# ------------------------------------------------------------------ F

def clean_ctes(profile: str, src: str, col: str = "answer", key: str = "printf('%020d:%010d', conv_id, q_turn)",
               p: str = "cl") -> str:
    """DuckDB mirror of ``clean_answers``: CTEs ``{p}_1..`` ending in ``{p}`` = src columns + ``cleaned``."""
    if profile in ("fast", "improved"):
        prefixes = L.PREFIXES_FAST if profile == "fast" else L.PREFIXES_IMPROVED
        rx = A.prefix_strip_first_re(prefixes)
        limit, window = (500, 500) if profile == "fast" else (1500, 1502)
        empty_test = f"coalesce({p}_s, '') = ''" if profile == "fast" else f"coalesce({col}, '') = ''"
        return f"""{p}_1 AS (SELECT *, {D.strip(col)} AS {p}_s FROM {src}),
{p}_2 AS (SELECT *, regexp_replace({p}_s, {D.lit(rx)}, '') AS {p}_p FROM {p}_1),
{p}_3 AS (SELECT *, CASE WHEN length({p}_p) > {limit} THEN {D.strip(D.sentence_prefix(f'{p}_p', window))}
                         ELSE {p}_p END AS {p}_t FROM {p}_2),
{p} AS (SELECT * EXCLUDE ({p}_s, {p}_p, {p}_t), CASE WHEN {empty_test} THEN {D.lit(L.EMPTY_MSG[profile])}
  WHEN {p}_t = '' THEN {D.lit(L.TRUNCATED_EMPTY_MSG[profile])} ELSE {p}_t END AS cleaned FROM {p}_3)"""
    prefixes = {"flan": L.PREFIXES_FLAN, "orca": L.PREFIXES_ORCA, "advanced": L.PREFIXES_ADVANCED}[profile]
    skip = {"flan": L.SKIP_LINES_FLAN, "orca": L.SKIP_LINES_ORCA, "advanced": L.SKIP_LINES_ADVANCED}[profile]
    limit = {"flan": 500, "orca": 2500, "advanced": 2000}[profile]
    rx = A.prefix_strip_sequential_re(prefixes)
    pe = f"regexp_replace({D.strip(col)}, {D.lit(rx)}, '')"
    if profile == "flan":
        for ph in L.REMOVE_PHRASES_FLAN:
            pe = D.strip(f"replace({pe}, {D.lit(ph)}, '')")
    steps = f"{p}_2 AS (SELECT *, {pe} AS {p}_p FROM {src})"
    last = f"{p}_2"
    if profile == "advanced":
        pick = D.opener_pick(key, L.OPENERS)
        steps += f""",
{p}_2b AS (SELECT * REPLACE (CASE WHEN {D.starts_with_any(f'lower({p}_p)', L.OPENER_CHECKS)} OR {pick} = ''
                                  THEN {p}_p ELSE {pick} || ' ' || {p}_p END AS {p}_p) FROM {p}_2)"""
        last = f"{p}_2b"
    sep = "' '" if profile == "flan" else "chr(10)"
    if profile == "flan":
        cut = f"CASE WHEN {p}_f <> '' THEN {D.strip(p + '_f')} ELSE substring({p}_c, 1, {limit - 3}) || '...' END"
    else:
        cut = f"CASE WHEN length({p}_f) > 100 THEN {D.strip(p + '_f')} ELSE substring({p}_c, 1, {limit - 3}) || '...' END"
    return f"""{steps},
{p}_3 AS (SELECT *, {D.filter_lines(f'{p}_p', skip)} AS {p}_lines FROM {last}),
{p}_4 AS (SELECT *, array_to_string({p}_lines, {sep}) AS {p}_c FROM {p}_3),
{p}_5 AS (SELECT *, {D.sentence_prefix(f'{p}_c', limit)} AS {p}_f FROM {p}_4),
{p} AS (SELECT * EXCLUDE ({p}_p, {p}_lines, {p}_c, {p}_f), CASE WHEN coalesce({col}, '') = '' THEN {D.lit(L.EMPTY_MSG[profile])}
  WHEN len({p}_lines) = 0 THEN {D.lit(L.NO_LINES_MSG[profile])}
  WHEN length({p}_c) > {limit} THEN {cut} ELSE {p}_c END AS cleaned FROM {p}_5)"""


def _clean_sql(profile: str) -> str:
    return f"WITH {_AN}, {clean_ctes(profile, 'answers')} SELECT conv_id, q_turn, variant, cleaned FROM cl"


def _clean_query(profile: str):
    def q(spark, sf):
        a = answers(spark, sf).withColumn("_key", row_key("conv_id", "q_turn"))
        c = A.clean_answers(a, "answer", profile, key="_key")
        return c.select("conv_id", "q_turn", "variant", "cleaned")
    return q


# F1-F9 run as one profile-specific chain; each profile is one registered query.
for _p, _ids in [("fast", "f1_f3_f6_f7"), ("flan", "f2_f4_f5_f6_f7_f8"), ("orca", "f2_f5_f6_f7_f8"),
                 ("advanced", "f2_f9_f5_f6_f7_f8"), ("improved", "f3_f6_f7")]:
    register(f"{_ids.split('_')[0]}_clean_answers_{_p}", sql=_clean_sql(_p))(_clean_query(_p))


# answers longer than every limit without a sentence end, so the cut falls back to dots or to the fixed message.
_LONG = f"{_AN}, long AS (SELECT conv_id, q_turn, variant, replace(repeat(coalesce(question, 'x') || ' word ', 400), '.', ',') AS answer FROM answers)"


def _long_answers(spark, sf):
    a = answers(spark, sf)
    return a.withColumn("answer", F.replace(F.repeat(F.concat(F.coalesce("question", F.lit("x")), F.lit(" word ")), 400), F.lit("."), F.lit(",")))


def _long_query(profile: str):
    def q(spark, sf):
        c = A.clean_answers(_long_answers(spark, sf).withColumn("_key", row_key("conv_id", "q_turn")), "answer", profile, key="_key")
        return c.select("conv_id", "q_turn", "cleaned")
    return q


for _p in ("fast", "flan", "orca", "advanced", "improved"):
    register(f"f7_truncation_{_p}", sql=f"WITH {_LONG}, {clean_ctes(_p, 'long')} SELECT conv_id, q_turn, cleaned FROM cl")(_long_query(_p))


@register("f10_failed_answers", sql=f"""WITH
nx AS (SELECT * FROM (
  SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')
SELECT conv_id, turn AS q_turn, coalesce(next_role, '') <> 'assistant' AS is_error,
       CASE WHEN coalesce(next_role, '') <> 'assistant' THEN {D.lit(L.APOLOGY['advanced'])} ELSE next_text END AS reply
FROM nx""")
def f10_failed_answers(spark, sf):
    """A user turn without an assistant reply right after it is a failed request."""
    from ..sources.tables import table
    u = next_message(table(spark, sf, "conversations")).filter(F.col("role") == "user")
    failed = F.coalesce(F.col("next_role"), F.lit("")) != "assistant"
    return u.select("conv_id", F.col("turn").alias("q_turn"), failed.alias("is_error"),
                    A.substitute_failures(F.col("next_text"), failed).alias("reply"))


# ------------------------------------------------------------------ G

N_SOURCES = 5    # the advanced profile hands the 5 retrieved documents to validation

_G_CTE = f"""{_AN}, g AS (
  SELECT conv_id, q_turn, answer, question,
         {D.g_confidence('answer', L)} AS confidence_score,
         {D.g_relevance('answer', 'question', str(N_SOURCES))} AS relevance_score,
         {D.g_completeness('answer', L)} AS completeness_score,
         {D.g_clarity('answer', L)} AS clarity_score FROM answers),
g2 AS (SELECT *, confidence_score * {D.dbl(0.3)} + relevance_score * {D.dbl(0.3)}
                 + completeness_score * {D.dbl(0.2)} + clarity_score * {D.dbl(0.2)} AS overall_quality FROM g),
g3 AS (SELECT *, overall_quality >= {D.dbl(0.6)} AS validation_passed,
  list_filter([CASE WHEN confidence_score < 0.5 THEN 'Low confidence' END,
               CASE WHEN relevance_score < 0.5 THEN 'Low relevance' END,
               CASE WHEN completeness_score < 0.5 THEN 'Incomplete response' END,
               CASE WHEN clarity_score < 0.5 THEN 'Unclear response' END], lambda z: z IS NOT NULL) AS issues
  FROM g2)"""


def _validated(spark, sf):
    a = answers(spark, sf).withColumn("n_sources", F.lit(N_SOURCES))
    return A.validate_answers(a, "answer", "question", "n_sources")


def _g_query(col: str):
    def q(spark, sf):
        return _validated(spark, sf).select("conv_id", "q_turn", F.round(col, 6).alias(col))
    return q


for _gid, _col in [("g1", "confidence_score"), ("g2", "relevance_score"),
                   ("g3", "completeness_score"), ("g4", "clarity_score")]:
    register(f"{_gid}_{_col}", sql=f"WITH {_G_CTE} SELECT conv_id, q_turn, round({_col}, 6) AS {_col} FROM g3"
             )(_g_query(_col))


@register("g5_overall_quality", sql=f"""WITH {_G_CTE}
SELECT conv_id, q_turn, round(overall_quality, 6) AS overall_quality, validation_passed FROM g3""")
def g5_overall_quality(spark, sf):
    return _validated(spark, sf).select("conv_id", "q_turn", F.round("overall_quality", 6).alias("overall_quality"),
                                        "validation_passed")


@register("g6_issue_list", sql=f"""WITH {_G_CTE}
SELECT conv_id, q_turn, array_to_string(issues, '|') AS issues FROM g3""")
def g6_issue_list(spark, sf):
    return _validated(spark, sf).select("conv_id", "q_turn", F.array_join("issues", "|").alias("issues"))


@register("g7_quality_report", sql=f"""WITH {_G_CTE}
SELECT count(*) AS answers,
       round(avg(confidence_score), 6) AS avg_confidence_score, round(avg(relevance_score), 6) AS avg_relevance_score,
       round(avg(completeness_score), 6) AS avg_completeness_score, round(avg(clarity_score), 6) AS avg_clarity_score,
       round(avg(overall_quality), 6) AS avg_overall_quality,
       count_if(validation_passed) / count(*) AS pass_rate,
       count_if(list_contains(issues, 'Low confidence')) AS n_low_confidence,
       count_if(list_contains(issues, 'Low relevance')) AS n_low_relevance,
       count_if(list_contains(issues, 'Incomplete response')) AS n_incomplete_response,
       count_if(list_contains(issues, 'Unclear response')) AS n_unclear_response
FROM g3""")
def g7_quality_report(spark, sf):
    r = A.quality_report(_validated(spark, sf))
    return r.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") else c for c in r.columns])


@register("e2_enhance_question_flan", sql=f"""WITH {_QS}
SELECT qid, CASE WHEN {D.contains_any('lower(text)', L.DOMAIN_KEYWORDS_7)} THEN text
            ELSE {D.lit(L.DOMAIN_PREFIX)} || text END AS enhanced FROM questions""")
def e2_enhance_question_flan(spark, sf):
    """E2 with the first profile's 7 keywords."""
    return questions(spark, sf).select("qid", Q.enhance_question("text", L.DOMAIN_KEYWORDS_7).alias("enhanced"))


# E3, E4 with the lexicons as tables: the same answers by one automaton over all patterns.

def _pattern_table(spark):
    return spark.createDataFrame([(i, c, p) for i, (c, ps) in enumerate(L.QUERY_PATTERNS.items()) for p in ps], "priority int, query_type string, pattern string")


def _synonym_table(spark):
    rows = [(h, s) for h, syn in L.DOMAIN_SYNONYMS.items() for s in syn] + [(w, w) for w in L.EXTRA_DOMAIN_WORDS]
    return spark.createDataFrame(rows, "head string, synonym string")


@register("e3_classify_by_table", sql=f"""WITH {_QS}
SELECT qid, {D.classify('text', L.QUERY_PATTERNS)} AS query_type FROM questions""")
def e3_classify_by_table(spark, sf):
    from ..operators.patterns import classify_by
    return classify_by(questions(spark, sf).select("qid", "text"), "text", _pattern_table(spark)).select("qid", "query_type")


@register("e4_terms_by_table", sql=f"""WITH {_QS}
SELECT qid, array_to_string({D.extract_terms('text', L.DOMAIN_SYNONYMS, L.EXTRA_DOMAIN_WORDS)}, '|') AS retail_terms FROM questions""")
def e4_terms_by_table(spark, sf):
    from ..operators.patterns import terms_by
    t = terms_by(questions(spark, sf).select("qid", "text"), "text", _synonym_table(spark))
    return t.select("qid", F.array_join("retail_terms", "|").alias("retail_terms"))


_HEADS = {h: list(syn)[:3] for h, syn in list(L.DOMAIN_SYNONYMS.items())[:5]}


def _expand_sql(x: str) -> str:
    low = f"lower({x})"
    parts = [f"CASE WHEN contains({low}, {D.lit(h)}) AND NOT contains({low}, {D.lit(s)}) THEN {D.lit(s)} END" for h, syn in _HEADS.items() for s in syn]
    extra = f"list_filter([{', '.join(parts)}], lambda z: z IS NOT NULL)"
    return f"""CASE WHEN len({extra}) = 0 THEN {x} ELSE {x} || ' ' || array_to_string(list_transform(list_filter(list_zip({extra}, range(1, len({extra}) + 1)),
      lambda z: list_position({extra}, z[1]) = z[2]), lambda z: z[1]), ' ') END"""


@register("e8_expand_questions", sql=f"WITH {_QS} SELECT qid, {_expand_sql('text')} AS expanded_query FROM questions")
def e8_expand_questions(spark, sf):
    """The question followed by synonyms of the first lexicon heads it holds."""
    return Q.expand_questions(questions(spark, sf), _HEADS).select("qid", "expanded_query")
