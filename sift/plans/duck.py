"""DuckDB SQL fragments that mirror the Spark column functions.

Used only to write the oracle SQL for each registered query; the engine
itself never runs DuckDB.
"""

from __future__ import annotations

from ..functions.text import WORD_RE, WS, WS_CHARS
from ..operators.lexical import STOP_WORDS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


_WS_SQL = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)


def strip(x: str) -> str:
    return f"trim({x}, {_WS_SQL})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(WORD_RE)})"


def kept_tokens(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({str_list(STOP_WORDS)}, t))"


def terms_from_kept(k: str) -> str:
    return f"list_concat({k}, list_transform(range(1, len({k})), lambda i: {k}[i] || ' ' || {k}[i + 1]))"


def contains_any(x: str, needles) -> str:
    needles = list(needles)
    if not needles:
        return "false"
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def bucket(t: str, dim: int) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % {dim})"


def hash_embed_ctes(name: str, src: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """CTEs ``{name}_tok``, ``{name}_cnt`` and ``{name}`` (id, embedding DOUBLE[])."""
    counts = ", ".join(f"count_if(b = {i}) AS c{i}" for i in range(dim))
    sq = " + ".join(f"coalesce(c{i},0)*coalesce(c{i},0)" for i in range(dim))
    vec = ", ".join(f"CASE WHEN n > 0 THEN coalesce(c{i},0) / n ELSE 0.0 END" for i in range(dim))
    return f"""
{name}_tok AS (SELECT {id_col} AS id, {bucket('t', dim)} AS b
               FROM (SELECT {id_col}, unnest({tokens(text_col)}) AS t FROM {src})),
{name}_cnt AS (SELECT id, {counts} FROM {name}_tok GROUP BY id),
{name}_n AS (SELECT s.{id_col} AS id, c.*, sqrt(({sq})::DOUBLE) AS n
             FROM (SELECT DISTINCT {id_col} FROM {src}) s LEFT JOIN {name}_cnt c ON c.id = s.{id_col}),
{name} AS (SELECT id, [{vec}]::DOUBLE[] AS embedding FROM {name}_n)"""


def line_chunks_cte(name: str = "line_chunks", docs: str = "documents") -> str:
    return f"""
{name} AS (
  SELECT printf('%020d:%010d', doc_id, i - 1) AS chunk_id, doc_id, source, (i - 1)::INTEGER AS chunk_no,
         {strip('parts[i]')} AS content
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM {docs}) d,
       range(1, len(parts) + 1) r(i)
  WHERE length({strip('parts[i]')}) > 0)"""


def cos_dist(a: str, b: str) -> str:
    """1 - cos as numpy computes it: dot / (|a| |b|), 0 when a norm is 0."""
    den = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return f"(1.0 - CASE WHEN {den} > 0 THEN list_inner_product({a}, {b}) / {den} ELSE 0.0 END)"


def l2sq_dist(a: str, b: str) -> str:
    return (f"greatest(list_inner_product({a}, {a}) + list_inner_product({b}, {b})"
            f" - 2.0 * list_inner_product({a}, {b}), 0.0)")


def tfidf_ctes(chunks: str, id_col: str = "chunk_id", text_col: str = "content",
               max_features: int = 5000, prefix: str = "ix") -> str:
    """CTEs ``{prefix}_tf`` (id, term, tf), ``{prefix}_vocab`` (term, cf, df, idf),
    ``{prefix}_post`` (id, term, tf, weight)."""
    return f"""
{prefix}_kept AS (SELECT {id_col} AS id, {kept_tokens(text_col)} AS k FROM {chunks}),
{prefix}_terms AS (SELECT id, unnest({terms_from_kept('k')}) AS term FROM {prefix}_kept),
{prefix}_tf AS (SELECT id, term, count(*) AS tf FROM {prefix}_terms GROUP BY id, term),
{prefix}_ndocs AS (SELECT count(*) AS n FROM {chunks}),
{prefix}_vocab AS (
  SELECT term, cf, df, ln((1.0 + (SELECT n FROM {prefix}_ndocs)) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, sum(tf) AS cf, count(*) AS df FROM {prefix}_tf GROUP BY term
    ORDER BY cf DESC, term ASC LIMIT {max_features})),
{prefix}_raw AS (SELECT t.id, t.term, t.tf, t.tf * v.idf AS raw FROM {prefix}_tf t JOIN {prefix}_vocab v USING (term)),
{prefix}_post AS (SELECT id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM {prefix}_raw)"""


def query_weight_ctes(queries: str, qid_col: str, text_col: str, vocab: str, prefix: str = "qw") -> str:
    return f"""
{prefix}_kept AS (SELECT {qid_col} AS qid, {kept_tokens(text_col)} AS k FROM {queries}),
{prefix}_terms AS (SELECT qid, unnest({terms_from_kept('k')}) AS term FROM {prefix}_kept),
{prefix}_tf AS (SELECT qid, term, count(*) AS tf FROM {prefix}_terms GROUP BY qid, term),
{prefix}_raw AS (SELECT t.qid, t.term, t.tf * v.idf AS raw FROM {prefix}_tf t JOIN {vocab} v USING (term)),
{prefix} AS (SELECT qid, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)) AS qweight FROM {prefix}_raw)"""


def lexical_hits_cte(name: str, qw: str, post: str, k: int) -> str:
    return f"""
{name}_s AS (SELECT q.qid, p.id AS chunk_id, sum(q.qweight * p.weight) AS score
             FROM {qw} q JOIN {post} p USING (term) GROUP BY q.qid, p.id HAVING sum(q.qweight * p.weight) > 0),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
                          FROM {name}_s) WHERE rank <= {k})"""


def semantic_hits_cte(name: str, qvec: str, cvec: str, k: int, metric: str = "cosine") -> str:
    d = cos_dist("q.embedding", "c.embedding") if metric == "cosine" else (
        l2sq_dist("q.embedding", "c.embedding") if metric == "l2"
        else "(1.0 - list_inner_product(q.embedding, c.embedding))")
    return f"""
{name}_d AS (SELECT q.id AS qid, c.id AS chunk_id, {d} AS distance FROM {qvec} q, {cvec} c),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), chunk_id) AS rank
                          FROM {name}_d) WHERE rank <= {k})"""


def hybrid_ctes(sem: str, lex: str, chunks: str, k: int, name: str = "hyb") -> str:
    return f"""
{name}_sem AS (SELECT qid, chunk_id, rank,
    1.0 - (distance - min(distance) OVER w) / CASE WHEN max(distance) OVER w <> min(distance) OVER w
          THEN max(distance) OVER w - min(distance) OVER w ELSE 1.0 END AS sem_score
    FROM {sem} WINDOW w AS (PARTITION BY qid)),
{name}_lex AS (SELECT qid, chunk_id, rank,
    (score - min(score) OVER w) / CASE WHEN max(score) OVER w <> min(score) OVER w
          THEN max(score) OVER w - min(score) OVER w ELSE 1.0 END AS lex_score
    FROM {lex} WINDOW w AS (PARTITION BY qid)),
{name}_tag AS (
    SELECT qid, chunk_id, rank, sem_score, NULL::DOUBLE AS lex_score, 0 AS side FROM {name}_sem
    UNION ALL
    SELECT qid, chunk_id, rank, NULL::DOUBLE, lex_score, 1 FROM {name}_lex),
{name}_m AS (
    SELECT t.qid, c.content, coalesce(max(sem_score), 0.0) AS semantic_score,
           coalesce(max(lex_score), 0.0) AS keyword_score,
           min({{'side': side, 'rank': rank, 'chunk_id': t.chunk_id}}) AS f
    FROM {name}_tag t JOIN {chunks} c ON c.chunk_id = t.chunk_id GROUP BY t.qid, c.content),
{name}_s AS (
    SELECT qid, content, semantic_score, keyword_score, f.side AS first_side, f.rank AS first_rank,
           f.chunk_id AS chunk_id,
           0.7 * semantic_score + 0.3 * keyword_score AS hybrid_score,
           CASE WHEN semantic_score > 0 AND keyword_score > 0
                THEN least(least(semantic_score * 0.6 + keyword_score * 0.4, 1.0) * 1.2, 1.0)
                ELSE least(semantic_score * 0.6 + keyword_score * 0.4, 1.0) END AS confidence
    FROM {name}_m),
{name} AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(hybrid_score, 9) DESC, first_side, first_rank) AS rank
    FROM {name}_s) WHERE rank <= {k})"""


# ---------------------------------------------------------------- questions / answers

def dbl(v: float) -> str:
    return f"{v!r}::DOUBLE"


def classify(x: str, patterns) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN {contains_any(low, pats)} THEN {lit(cls)}" for cls, pats in patterns.items())
    return f"(CASE {whens} ELSE 'general' END)"


def extract_terms(x: str, synonyms, extra) -> str:
    low = f"lower({x})"
    items = [f"CASE WHEN {contains_any(low, [h, *s])} THEN {lit(h)} END" for h, s in synonyms.items()]
    items += [f"CASE WHEN contains({low}, {lit(w)}) THEN {lit(w)} END" for w in extra]
    return f"list_sort(list_distinct(list_filter([{', '.join(items)}], lambda z: z IS NOT NULL)))"


def hints(t: str, hint_map) -> str:
    whens = " ".join(f"WHEN {t} = {lit(c)} THEN {str_list(h)}" for c, h in hint_map.items())
    return f"(CASE {whens} ELSE []::VARCHAR[] END)"


def question_confidence(x: str, terms: str) -> str:
    wc = word_count(x)
    return (f"least({dbl(0.5)} + least(len({terms}) * {dbl(0.1)}, {dbl(0.3)}) + "
            f"CASE WHEN {wc} BETWEEN 5 AND 20 THEN {dbl(0.2)} "
            f"ELSE greatest({dbl(0.0)}, {dbl(0.2)} - abs({wc} - 12) * {dbl(0.01)}) END, {dbl(1.0)})")


def starts_with_any(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)})" for p in prefixes) + ")"


def filter_lines(x: str, skip) -> str:
    return (f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), "
            f"lambda l: length(l) > 3 AND NOT {contains_any('lower(l)', skip)})")


def sentence_prefix(x: str, window: int) -> str:
    return f"regexp_extract(substring({x}, 1, {window}), {lit('(?s)^(.*[.] )')}, 1)"


def opener_pick(key: str, openers) -> str:
    return f"{str_list(openers)}[({bucket(f'CAST({key} AS VARCHAR)', len(openers))}) + 1]"


def clamp01(s: str) -> str:
    return f"greatest({dbl(0.0)}, least({dbl(1.0)}, {s}))"


def g_confidence(r: str, L) -> str:
    low = f"lower({r})"
    return clamp01(f"{dbl(0.5)} + CASE WHEN length({r}) BETWEEN 50 AND 1000 THEN {dbl(0.2)} ELSE {dbl(0.0)} END"
                   f" + CASE WHEN {contains_any(low, L.SPECIFIC_WORDS)} THEN {dbl(0.1)} ELSE {dbl(0.0)} END"
                   f" - CASE WHEN {contains_any(low, L.UNCERTAIN_WORDS)} THEN {dbl(0.2)} ELSE {dbl(0.0)} END")


def g_relevance(r: str, q: str, n_sources: str) -> str:
    qt = f"list_distinct({words(f'lower({q})')})"
    rt = f"list_distinct({words(f'lower({r})')})"
    ov = f"len(list_intersect({qt}, {rt}))"
    return clamp01(f"{dbl(0.5)} + CASE WHEN {ov} > 0 THEN least({ov} / len({qt}), {dbl(0.3)}) ELSE {dbl(0.0)} END"
                   f" + CASE WHEN {n_sources} > 0 THEN {dbl(0.2)} ELSE {dbl(0.0)} END")


def g_completeness(r: str, L) -> str:
    return clamp01(f"{dbl(0.5)} + CASE WHEN length({r}) >= 100 THEN {dbl(0.3)} ELSE {dbl(0.0)} END"
                   f" + CASE WHEN {contains_any(r, L.STRUCTURE_MARKS)} THEN {dbl(0.2)} ELSE {dbl(0.0)} END")


def g_clarity(r: str, L) -> str:
    pieces = f"string_split({r}, '.')"
    total = f"list_sum(list_transform({pieces}, lambda p: len({words('p')})))"
    avg = f"({total} / greatest(len({pieces}), 1))"
    return clamp01(f"{dbl(0.5)} + CASE WHEN {avg} >= 10 AND {avg} <= 25 THEN {dbl(0.3)} ELSE {dbl(0.0)} END"
                   f" + CASE WHEN {contains_any(f'lower({r})', L.CONNECTORS)} THEN {dbl(0.2)} ELSE {dbl(0.0)} END")
