"""Registered queries: chunking inputs, embeddings, vector / keyword / hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.vectors import similarity_from_distance
from ..operators import hybrid as H
from ..operators.lexical import bm25_search, build_tfidf, keyword_search, lexical_search, load_index, query_weights, save_index
from ..operators.retrieval import retrieve, semantic_search
from ..operators.block_max import block_max_search, build_block_index
from ..operators.ivf import build_ivf, ivf_search
from ..operators.segments import add_segment, merge_segments, segment_search
from ..session import drop_path, scratch_path
from ..sources.tables import table
from . import duck as D
from .inputs import bench_queries, chunk_vectors, label_centroids, line_chunks, query_vectors
from .registry import register

HYB_K = 5            # advanced profile: 5 results, each side fetches 2k


# ------------------------------------------------------------------ B2 / C1

@register("b2_line_chunks", sql=f"WITH {D.line_chunks_cte()} SELECT * FROM line_chunks")
def b2_line_chunks(spark, sf):
    return line_chunks(spark, sf)


_EMB_DOCS = D.hash_embed_ctes("dv", "documents", "doc_id", "text")


@register("c1_hash_embed", sql=f"""WITH {_EMB_DOCS}
SELECT id AS doc_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM dv""")
def c1_hash_embed(spark, sf):
    from ..operators.embedding import hash_embed
    v = hash_embed(table(spark, sf, "documents"), "doc_id", "text")
    return v.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@register("c1_embed_hook", sql=f"""WITH {_EMB_DOCS}
SELECT id AS doc_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM dv""")
def c1_embed_hook(spark, sf):
    """The same vectors from a batch function handed to the model hook."""
    from ..operators.embedding import embed_with

    def model(texts):
        import hashlib
        import numpy as np
        import regex
        out = np.zeros((len(texts), 64))
        for i, t in enumerate(texts):
            for tok in regex.findall(r"[\p{L}\p{N}_]{2,}", t.lower()):
                out[i, int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 64] += 1
        return out

    v = embed_with(table(spark, sf, "documents").select("doc_id", "text"), "text", model, 64)
    return v.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# ------------------------------------------------------------------ D1 / D2 / D3

_CENT = """
cent_m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
cent AS (SELECT label AS id, list(m ORDER BY i) AS embedding FROM cent_m GROUP BY label),
vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings)"""


def _vec_corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@register("d1_semantic_search", sql=f"""WITH {_CENT}, {D.semantic_hits_cte('hits', 'cent', 'vecs', 10)}
SELECT qid AS label, chunk_id AS vec_id, round(distance, 6) AS distance, rank FROM hits""")
def d1_semantic_search(spark, sf):
    hits = semantic_search(label_centroids(spark, sf), _vec_corpus(spark, sf), 10, "cosine",
                           qid_col="label")
    return hits.select("label", F.col("chunk_id").alias("vec_id"),
                       F.round("distance", 6).alias("distance"), "rank")


@register("d2_similarity", sql=f"""WITH {_CENT}, {D.semantic_hits_cte('hits', 'cent', 'vecs', 10, 'l2')}
SELECT qid AS label, chunk_id AS vec_id, round(1.0 - distance, 6) AS similarity, rank FROM hits""")
def d2_similarity(spark, sf):
    hits = semantic_search(label_centroids(spark, sf), _vec_corpus(spark, sf), 10, "l2",
                           qid_col="label")
    return hits.select("label", F.col("chunk_id").alias("vec_id"),
                       F.round(similarity_from_distance("distance"), 6).alias("similarity"), "rank")


_QV_CV = f"""{D.line_chunks_cte()},
bq AS (SELECT item_id AS qid, text FROM benchmark),
{D.hash_embed_ctes('qv', 'bq', 'qid', 'text')},
{D.hash_embed_ctes('cv', 'line_chunks', 'chunk_id', 'content')}"""


@register("d3_retrieve", sql=f"""WITH {_QV_CV}, {D.semantic_hits_cte('hits', 'qv', 'cv', 3)}
SELECT qid, chunk_id, rank FROM hits""")
def d3_retrieve(spark, sf):
    return retrieve(query_vectors(spark, sf), chunk_vectors(spark, sf), 3, metric="cosine")


# ------------------------------------------------------------------ D6 / D7 / D8

_IX = f"""{D.line_chunks_cte()}, {D.tfidf_ctes('line_chunks')}"""


def _index(spark, sf):
    return build_tfidf(line_chunks(spark, sf))


@register("d6_tfidf_vocab", sql=f"""WITH {_IX}
SELECT term, cf, df, round(idf, 6) AS idf FROM ix_vocab""")
def d6_tfidf_vocab(spark, sf):
    vocab, _ = _index(spark, sf)
    return vocab.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


_LEX = f"""{_IX}, bq AS (SELECT item_id AS qid, text FROM benchmark),
{D.query_weight_ctes('bq', 'qid', 'text', 'ix_vocab')},
{D.lexical_hits_cte('lex', 'qw', 'ix_post', 10)}"""


@register("d7_lexical_search", sql=f"""WITH {_LEX}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM lex""")
def d7_lexical_search(spark, sf):
    vocab, _ = _index(spark, sf)
    hits = keyword_search(bench_queries(spark, sf), line_chunks(spark, sf), 10, vocab)
    return hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register("d7_stored_index_search", sql=f"""WITH {_LEX}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM lex""")
def d7_stored_index_search(spark, sf):
    """The same answers from an index stored once and read back (join on term)."""
    path = scratch_path(spark, "keyword-index")
    save_index(*_index(spark, sf), path)
    vocab, post = load_index(spark, path)
    hits = lexical_search(query_weights(bench_queries(spark, sf), vocab), post, 10)
    return hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


_BM25 = f"""{_IX}, bq AS (SELECT item_id AS qid, text FROM benchmark),
bm_len AS (SELECT id, sum(tf) AS len FROM ix_tf GROUP BY id),
bm_avg AS (SELECT (SELECT sum(len) FROM bm_len)::DOUBLE / (SELECT n FROM ix_ndocs) AS a),
bm_df AS (SELECT term, count(*) AS df FROM ix_tf GROUP BY term),
bm_qk AS (SELECT item_id AS qid, {D.kept_tokens('text')} AS k FROM benchmark),
bm_qt AS (SELECT DISTINCT qid, unnest({D.terms_from_kept('k')}) AS term FROM bm_qk),
bm_q AS (SELECT q.qid, q.term, ln(1.0 + ((SELECT n FROM ix_ndocs) - d.df + 0.5) / (d.df + 0.5)) AS idf
         FROM bm_qt q JOIN bm_df d USING (term)),
bm_s AS (SELECT q.qid, t.id AS chunk_id,
                sum(q.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / (SELECT a FROM bm_avg)))) AS score
         FROM bm_q q JOIN ix_tf t USING (term) JOIN bm_len l ON l.id = t.id
         GROUP BY q.qid, t.id HAVING score > 0),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
                      FROM bm_s) WHERE rank <= 10)"""


@register("d8_bm25_search", sql=f"""WITH {_BM25}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm""")
def d8_bm25_search(spark, sf):
    hits = bm25_search(bench_queries(spark, sf), line_chunks(spark, sf), 10)
    return hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _block_max(spark, sf, scorer: str):
    path = scratch_path(spark, f"block-max-{scorer}")
    index = build_block_index(line_chunks(spark, sf), path, scorer)
    hits = block_max_search(index, bench_queries(spark, sf), 10)
    return drop_path(spark, path, hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank"))


@register("d7_block_max_search", sql=f"""WITH {_LEX}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM lex""")
def d7_block_max_search(spark, sf):
    """Keyword top-10 from a stored index whose blocks are skipped by their largest weights."""
    return _block_max(spark, sf, "tfidf")


@register("d8_block_max_search", sql=f"""WITH {_BM25}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm""")
def d8_block_max_search(spark, sf):
    return _block_max(spark, sf, "bm25")


def _ingests(spark, sf):
    """All line chunks in three ingests by document; every fifth document comes first in an old version, then as it is."""
    chunks = line_chunks(spark, sf).withColumn("source", F.col("doc_id").cast("string"))
    part, old = F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.col("doc_id") % 5 == 0
    stale = chunks.withColumn("content", F.when(old, F.concat(F.reverse("content"), F.lit(" outdated line"))).otherwise(F.col("content")))
    return [stale.where(part == i) for i in range(3)] + [chunks.where(old)]


@register("d8_segment_search", sql=f"""WITH {_BM25}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm""")
def d8_segment_search(spark, sf):
    """BM25 over an index grown by three ingests and a change of every fifth document: equal to an index built anew."""
    path = scratch_path(spark, "segments")
    for seg, chunks in enumerate(_ingests(spark, sf)):
        add_segment(chunks, path, seg)
    hits = segment_search(spark, path, bench_queries(spark, sf), 10)
    return drop_path(spark, path, hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank"))


@register("d8_merged_segment_search", sql=f"""WITH {_BM25}
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm""")
def d8_merged_segment_search(spark, sf):
    """The same after the segments were merged into one."""
    path, merged = scratch_path(spark, "segments"), scratch_path(spark, "segments-merged")
    for seg, chunks in enumerate(_ingests(spark, sf)):
        add_segment(chunks, path, seg)
    merge_segments(spark, path, merged)
    drop_path(spark, path)  # it has no reader left
    hits = segment_search(spark, merged, bench_queries(spark, sf), 10)
    return drop_path(spark, merged, hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank"))


# ------------------------------------------------------------------ D9-D17 (hybrid)

def hybrid_hits(spark, sf, k: int = HYB_K):
    chunks = line_chunks(spark, sf)
    sem = semantic_search(query_vectors(spark, sf), chunk_vectors(spark, sf), 2 * k, "cosine")
    vocab, _ = build_tfidf(chunks)
    lex = keyword_search(bench_queries(spark, sf), chunks, 2 * k, vocab)
    return H.hybrid_search(sem, lex, chunks, k)


_HYB = f"""{_IX}, bq AS (SELECT item_id AS qid, text FROM benchmark),
{D.query_weight_ctes('bq', 'qid', 'text', 'ix_vocab')},
{D.lexical_hits_cte('lex', 'qw', 'ix_post', 2 * HYB_K)},
{D.hash_embed_ctes('qv', 'bq', 'qid', 'text')},
{D.hash_embed_ctes('cv', 'line_chunks', 'chunk_id', 'content')},
{D.semantic_hits_cte('sem', 'qv', 'cv', 2 * HYB_K)},
{D.hybrid_ctes('sem', 'lex', 'line_chunks', HYB_K)}"""

_HYB_COLS = ("qid, rank, chunk_id, content, round(semantic_score, 6) AS semantic_score, "
             "round(keyword_score, 6) AS keyword_score, round(hybrid_score, 6) AS hybrid_score, "
             "round(confidence, 6) AS confidence")


@register("d13_hybrid_search", sql=f"WITH {_HYB} SELECT {_HYB_COLS} FROM hyb")
def d13_hybrid_search(spark, sf):
    h = hybrid_hits(spark, sf)
    return H.round_scores(h.select("qid", "rank", "chunk_id", "content", "semantic_score",
                                   "keyword_score", "hybrid_score", "confidence"))


def _hybrid_parts(spark, sf, k: int = HYB_K):
    chunks = line_chunks(spark, sf)
    sem = semantic_search(query_vectors(spark, sf), chunk_vectors(spark, sf), 2 * k, "cosine")
    vocab, _ = build_tfidf(chunks)
    lex = keyword_search(bench_queries(spark, sf), chunks, 2 * k, vocab)
    sem_s = H.minmax(sem, "distance", "sem_score", invert=True)
    lex_s = H.minmax(lex, "score", "lex_score")
    return chunks, sem_s, lex_s


@register("d9_minmax", sql=f"""WITH {_HYB}
SELECT qid, 'semantic' AS side, chunk_id, rank, round(sem_score, 6) AS scaled FROM hyb_sem
UNION ALL
SELECT qid, 'keyword' AS side, chunk_id, rank, round(lex_score, 6) AS scaled FROM hyb_lex""")
def d9_minmax(spark, sf):
    _, sem_s, lex_s = _hybrid_parts(spark, sf)
    a = sem_s.select("qid", F.lit("semantic").alias("side"), "chunk_id", "rank",
                     F.round("sem_score", 6).alias("scaled"))
    b = lex_s.select("qid", F.lit("keyword").alias("side"), "chunk_id", "rank",
                     F.round("lex_score", 6).alias("scaled"))
    return a.unionByName(b)


@register("d10_merge_hits", sql=f"""WITH {_HYB}
SELECT qid, content, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score,
       first_side, first_rank, chunk_id FROM hyb_s""")
def d10_merge_hits(spark, sf):
    chunks, sem_s, lex_s = _hybrid_parts(spark, sf)
    m = H.merge_hits(sem_s, lex_s, chunks)
    return H.round_scores(m)


@register("d11_hybrid_score", sql=f"""WITH {_HYB}
SELECT qid, chunk_id, round(hybrid_score, 6) AS hybrid_score FROM hyb_s""")
def d11_hybrid_score(spark, sf):
    chunks, sem_s, lex_s = _hybrid_parts(spark, sf)
    s = H.hybrid_scores(H.merge_hits(sem_s, lex_s, chunks))
    return s.select("qid", "chunk_id", F.round("hybrid_score", 6).alias("hybrid_score"))


@register("d12_confidence", sql=f"""WITH {_HYB}
SELECT qid, chunk_id, round(confidence, 6) AS confidence FROM hyb_s""")
def d12_confidence(spark, sf):
    chunks, sem_s, lex_s = _hybrid_parts(spark, sf)
    s = H.hybrid_scores(H.merge_hits(sem_s, lex_s, chunks))
    return s.select("qid", "chunk_id", F.round("confidence", 6).alias("confidence"))


@register("d14_list_sizes", sql=f"""WITH {_HYB}
SELECT qid, count_if(side = 0) AS semantic_raw, count_if(side = 1) AS keyword_raw FROM hyb_tag GROUP BY qid""")
def d14_list_sizes(spark, sf):
    _, sem_s, lex_s = _hybrid_parts(spark, sf)
    return H.list_sizes(sem_s, lex_s)


@register("d14_search_report", sql=f"""WITH {_HYB}
SELECT qid, count_if(semantic_score > 0.1) AS semantic_results, count_if(keyword_score > 0.1) AS keyword_results,
       count(*) AS combined_results,
       round(arg_min(semantic_score, rank), 3) AS top_semantic, round(arg_min(keyword_score, rank), 3) AS top_keyword,
       round(arg_min(hybrid_score, rank), 3) AS top_hybrid
FROM hyb GROUP BY qid""")
def d14_search_report(spark, sf):
    return H.search_report(hybrid_hits(spark, sf))


_DOCS5 = f"""{D.semantic_hits_cte('s5', 'qv', 'cv', HYB_K)},
docs AS (SELECT s5.qid, s5.rank, c.content, c.source FROM s5 JOIN line_chunks c USING (chunk_id))"""


def _context_docs(spark, sf):
    hits = semantic_search(query_vectors(spark, sf), chunk_vectors(spark, sf), HYB_K, "cosine")
    return hits.join(line_chunks(spark, sf).select("chunk_id", "content", "source"), "chunk_id")


@register("d15_attach_scores", sql=f"""WITH {_HYB}, {_DOCS5},
hs AS (SELECT qid, content, max(hybrid_score) AS hs FROM hyb GROUP BY qid, content)
SELECT d.qid, d.rank, round(coalesce(nullif(hs.hs, 0.0), 0.5), 3) AS display_score
FROM docs d LEFT JOIN hs ON hs.qid = d.qid AND hs.content = d.content""")
def d15_attach_scores(spark, sf):
    a = H.attach_scores(_context_docs(spark, sf), hybrid_hits(spark, sf))
    return a.select("qid", "rank", "display_score")


@register("d16_cited_sources", sql=f"""WITH {_QV_CV}, {_DOCS5},
f AS (SELECT qid, coalesce(regexp_extract(source, '([^/\\\\]*)$', 1), 'Unknown') AS file, min(rank) AS first
      FROM docs GROUP BY qid, file)
SELECT qid, array_to_string(list(file ORDER BY first)[1:5], '|') AS sources,
       greatest(count(*) - 5, 0) AS more_sources FROM f GROUP BY qid""")
def d16_cited_sources(spark, sf):
    c = H.cited_sources(_context_docs(spark, sf), 5)
    return c.select("qid", F.array_join("sources", "|").alias("sources"), "more_sources")


@register("d17_as_documents", sql=f"""WITH {_HYB}
SELECT h.qid, h.rank, h.content AS page_content, CAST(h.chunk_id AS VARCHAR) AS meta_chunk_id, c.source AS meta_source,
       printf('%.6f', h.hybrid_score) AS meta_hybrid_score
FROM hyb h JOIN line_chunks c USING (chunk_id)""")
def d17_as_documents(spark, sf):
    h = hybrid_hits(spark, sf).join(line_chunks(spark, sf).select("chunk_id", "source"), "chunk_id")
    h = h.withColumn("hybrid_score", F.format_string("%.6f", F.col("hybrid_score")))
    d = H.as_documents(h)
    return d.select("qid", "rank", "page_content",
                    F.col("metadata")["chunk_id"].alias("meta_chunk_id"),
                    F.col("metadata")["source"].alias("meta_source"),
                    F.col("metadata")["hybrid_score"].alias("meta_hybrid_score"))


# ------------------------------------------------------------------ D4 / D5

def mmr_sql(head: str, k: int = 4, fetch_k: int = 8) -> tuple[str, str]:
    """(CTEs, select of qid, chunk_id, pick); ``head`` defines qv and cv."""
    picks = []
    prev = []
    ctes = [f"""{head}, {D.semantic_hits_cte('fk', 'qv', 'cv', fetch_k, 'l2')},
cand AS (SELECT fk.qid, fk.rank AS r, fk.chunk_id, c.embedding AS ce, q.embedding AS qe
         FROM fk JOIN cv c ON c.id = fk.chunk_id JOIN qv q ON q.id = fk.qid),
qs AS (SELECT qid, r, chunk_id, 1.0 - {D.cos_dist('qe', 'ce')} AS qsim FROM cand),
pr AS (SELECT a.qid, a.r AS r, b.r AS s, 1.0 - {D.cos_dist('a.ce', 'b.ce')} AS sim
       FROM cand a JOIN cand b ON a.qid = b.qid),
m1 AS (SELECT qid, r AS p1 FROM (SELECT qid, r, row_number() OVER (PARTITION BY qid ORDER BY round(qsim, 9) DESC, r) AS rn
                                 FROM qs) WHERE rn = 1)"""]
    for n in range(2, k + 1):
        prev = [f"p{i}" for i in range(1, n)]
        red = "greatest(" + ", ".join(f"(SELECT sim FROM pr WHERE pr.qid = q.qid AND pr.r = q.r AND pr.s = m.{p})"
                                      for p in prev) + ")" if len(prev) > 1 else \
            f"(SELECT sim FROM pr WHERE pr.qid = q.qid AND pr.r = q.r AND pr.s = m.{prev[0]})"
        notin = " AND ".join(f"q.r <> m.{p}" for p in prev)
        ctes.append(f"""m{n} AS (SELECT qid, {', '.join(prev)}, r AS p{n} FROM (
  SELECT q.qid, {', '.join('m.' + p for p in prev)}, q.r,
         row_number() OVER (PARTITION BY q.qid ORDER BY round(0.5 * q.qsim - 0.5 * {red}, 9) DESC, q.r) AS rn
  FROM qs q JOIN m{n - 1} m ON m.qid = q.qid WHERE {notin}) WHERE rn = 1)""")
    last = f"m{k}"
    for i in range(1, k + 1):
        picks.append(f"SELECT m.qid, qs.chunk_id, {i} AS pick FROM {last} m JOIN qs ON qs.qid = m.qid AND qs.r = m.p{i}")
    return ",\n".join(ctes), "\nUNION ALL\n".join(picks)


@register("d4_mmr", sql="WITH {}\n{}".format(*mmr_sql(_QV_CV)))
def d4_mmr(spark, sf):
    from ..operators.retrieval import mmr
    return mmr(query_vectors(spark, sf), chunk_vectors(spark, sf), k=4, fetch_k=8, lam=0.5, metric="l2")


@register("d5_ann_search")
def d5_ann_search(spark, sf):
    from ..operators.retrieval import ann_search
    hits = ann_search(label_centroids(spark, sf), _vec_corpus(spark, sf), 10, qid_col="label")
    return hits.select("label", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@register("d5_ann_recall", sql="SELECT DISTINCT CAST(label AS BIGINT) AS label, true AS recall_ok FROM embeddings")
def d5_ann_recall(spark, sf):
    """Is recall@10 of the LSH search against the exact L2 search at least 0.7 for the label, and 0.9 in the mean of all labels."""
    from ..operators.retrieval import ann_search, recall_at_k
    cent, corp = label_centroids(spark, sf), _vec_corpus(spark, sf)
    approx = ann_search(cent, corp, 10, qid_col="label")
    exact = semantic_search(cent, corp, 10, "l2", qid_col="label")
    mean = F.avg("recall").over(Window.partitionBy(F.lit(0)))  # one row a label
    return recall_at_k(approx, exact, "label").select("label", ((F.col("recall") >= 0.7) & (mean >= 0.9)).alias("recall_ok"))


@register("d5_ivf_search", sql=f"""WITH {_CENT}, {D.semantic_hits_cte('hits', 'cent', 'vecs', 10, 'l2')}
SELECT qid AS label, chunk_id AS vec_id, round(distance, 6) AS distance, rank FROM hits""")
def d5_ivf_search(spark, sf):
    """Nearest vectors from a stored inverted file; cells that may still hold a nearer one are scanned too, so the lists are exact."""
    path = scratch_path(spark, "ivf")
    index = build_ivf(_vec_corpus(spark, sf), path, 32, "l2")
    hits = ivf_search(index, label_centroids(spark, sf), 10, probes=4, exact=True, qid_col="label")
    return drop_path(spark, path, hits.select("label", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank"))


@register("d5_ivf_recall")
def d5_ivf_recall(spark, sf):
    """Recall@10 by label of the probed cells alone (half of them: these vectors have hardly any clusters)."""
    from ..operators.retrieval import recall_at_k
    path, cent, corp = scratch_path(spark, "ivf-recall"), label_centroids(spark, sf), _vec_corpus(spark, sf)
    hits = ivf_search(build_ivf(corp, path, 32, "l2"), cent, 10, probes=20, qid_col="label")
    found = recall_at_k(hits, semantic_search(cent, corp, 10, "l2", qid_col="label"), "label")
    return drop_path(spark, path, found)


def _cited_sql(cap: int, default: str) -> str:
    return f"""WITH {_QV_CV}, {_DOCS5},
f AS (SELECT qid, coalesce(regexp_extract(source, '([^/\\\\]*)$', 1), {D.lit(default)}) AS file, min(rank) AS first
      FROM docs GROUP BY qid, file)
SELECT qid, array_to_string(list(file ORDER BY first)[1:{cap}], '|') AS sources,
       greatest(count(*) - {cap}, 0) AS more_sources FROM f GROUP BY qid"""


def _cited_query(cap: int, default: str):
    def q(spark, sf):
        c = H.cited_sources(_context_docs(spark, sf), cap, default=default)
        return c.select("qid", F.array_join("sources", "|").alias("sources"), "more_sources")
    return q


# profile variants: first profile lists 3 sources ("Memory" when unknown), orca 6 plus a remainder count
register("d16_cited_sources_flan", sql=_cited_sql(3, "Memory"))(_cited_query(3, "Memory"))
register("d16_cited_sources_orca", sql=_cited_sql(6, "Unknown"))(_cited_query(6, "Unknown"))
