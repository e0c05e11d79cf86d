"""Keyword search in blocks of postings; the request table's corpus is cut once; term counts on codes."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sift.operators import lexical as lx
from sift.operators import retrieval as R


def term_rows(n, vocab, seed):
    rng = np.random.default_rng(seed)
    return [[(f"t{t}", float(rng.integers(1, 5))) for t in rng.choice(vocab, rng.integers(0, 6), replace=False)] for _ in range(n)]


def columns(rows):
    return [pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.string())), pa.array([[w for _, w in r] for r in rows], pa.list_(pa.float64()))]


def brute(queries, corpus, ids, k):
    out = []
    for q in queries:
        own = dict(q)
        scored = [(-sum(own.get(t, 0.0) * w for t, w in c), i) for c, i in zip(corpus, ids)]
        out.append([(i, -s) for s, i in sorted(x for x in scored if x[0] < 0)[:k]])
    return out


@pytest.mark.parametrize("few", [1, 10 ** 6])
def test_blocks_of_postings_give_the_rows_of_all_pairs(monkeypatch, few):
    """Scored query by query or many at once, in one block or several; whole numbers tie, a repeated query term counts once."""
    monkeypatch.setattr(R, "FEW_ROWS", few)
    monkeypatch.setattr(R, "TILE_VALUES", 3000)
    queries, corpus = term_rows(40, 30, 1), term_rows(900, 30, 2)
    ids = np.array([f"{i:04d}" for i in np.random.default_rng(3).permutation(900)])
    want = brute(queries, corpus, ids, 4)
    for step in (900, 250):
        top = R._SparseTopK(4, "", False)
        top.add_queries(pa.array(range(40)), columns([q + q[:1] for q in queries]))
        for lo in range(0, 900, step):
            parts = [(ids[a:a + 50], columns(corpus[a:a + 50])) for a in range(lo, min(lo + step, 900), 50)]
            top.add_rows(top.rows(parts))
        got = [[(i, s) for i, s in zip(top.best[2][top.best[0] == j], top.best[3][top.best[0] == j])] for j in range(40)]
        assert got == want


def test_held_rows_become_postings_once(spark, tmpdir_fresh, monkeypatch):
    """Queries in several Arrow batches pass rows that were made ready once for each cell."""
    log = tmpdir_fresh + "/log"

    class Watched(R._SparseTopK):
        def rows(self, parts):
            with open(log, "a") as f:
                f.write("block\n")
            return super().rows(parts)

    q = spark.range(600).selectExpr("id AS _q", "array('a', concat('b', id % 7)) AS _t", "array(1.0D, 2.0D) AS _w")
    c = spark.range(400).selectExpr("id AS _i", "array('a', concat('b', id % 9)) AS _t", "array(1.0D, 1.0D + id) AS _w")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        hits = R.block_join(q, c, lambda: Watched(2, "", False), "chunk_id", "score", cells=2, query_block=10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(hits) == 600 * 2 * 2 and len(open(log).read().split()) == 2


def test_request_corpus_is_cut_once(spark, tmpdir_fresh):
    from sift.plans.q_conv import run_request_table
    talk = [(c, t, r, f"{r} {c} asks about shoe size {t}") for c in range(3) for t, r in enumerate(("user", "assistant") * 2)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmpdir_fresh}/conversations.parquet")
    made = spark.sparkContext.accumulator(0)

    def cut(batches):
        for b in batches:
            made.add(len(b))
            yield b.assign(chunk_id=[f"{i:03d}" for i in b["id"]], content=[f"shoe number {i} of size {i % 4}" for i in b["id"]], source="a.txt")[["chunk_id", "content", "source"]]

    chunks = spark.range(60).mapInPandas(cut, "chunk_id string, content string, source string")
    assert all(r.n_docs == 5 for r in run_request_table(spark, tmpdir_fresh, "advanced", chunks).collect())
    assert made.value == 60


def test_many_queries_go_to_few_cells_before_they_are_too_many_to_hold(spark, monkeypatch):
    seen = []
    score = R.score_cells
    monkeypatch.setattr(R, "score_cells", lambda q, c, make, i, v, carry, n, **kw: seen.append(n) or score(q, c, make, i, v, carry, n, **kw))
    monkeypatch.setattr(R, "CELL_QUERIES", 100)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        q = spark.range(30).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
        c = spark.range(50).select(F.col("id").alias("chunk_id"), F.array((F.col("id") * 2).cast("double"), F.lit(1.0)).alias("embedding"))
        assert R.semantic_search(q, c, 3, "l2").count() == 90
        assert R.semantic_search(q.limit(1), c, 3, "l2").count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen == [spark.sparkContext.defaultParallelism, 64]


def test_summaries_count_codes_and_forget_words():
    """Sums of words and pairs, also where numbers of forgotten words are given up; only kept words are put into terms."""
    stop = pa.array(["the"])
    toks = [["red", "shoe", "the", "red", "shoe"], [], ["blue", "shoe"]] + [[f"x{i}", f"y{i}"] for i in range(400)] + [["red", "shoe"]] * 5
    batches = [pa.RecordBatch.from_arrays([pa.array(toks[a:a + 20], pa.list_(pa.string()))], names=["t"]) for a in range(0, len(toks), 20)]
    whole = {r["term"]: (r["cf"], r["df"]) for r in next(iter(lx._summaries(10 ** 6, ["the"])(iter(batches)))).to_pylist()}
    assert whole["red shoe"] == (7, 6) and whole["shoe red"] == (1, 1) and whole["shoe"] == (8, 7) and whole[None][1] == len(toks) and len(whole) == 1 + 6 + 1200
    few = {r["term"]: (r["cf"], r["lost"]) for r in next(iter(lx._summaries(30, ["the"])(iter(batches)))).to_pylist()}
    lost = few.pop(None)[1]
    assert lost > 0 and all(whole[t][0] - lost <= cf <= whole[t][0] for t, (cf, _) in few.items()) and {"red", "shoe", "red shoe"} <= set(few)
    row, code, tf, names, length = lx._terms(batches[0].column(0), stop, True, lx._words_of(["red shoe"]))
    assert set(names) == {"red", "shoe", "blue", "red shoe", "shoe red"} | {f"{c}{i}" for c in "xy" for i in range(17)}
    assert {names[c] for c in code.tolist()} == {"red", "shoe", "red shoe", "shoe red"} and length[:4].tolist() == [7, 0, 3, 3]


def test_stored_postings_are_scored_by_chunk(spark):
    """Postings in any order, repeated and without id: the sums of a join on term; neighbours leave the scan as one row."""
    rows = [(f"c{i % 50:02d}", f"t{(i * 7 + i // 50) % 40}", 1.0 + i % 3) for i in range(400)] + [(None, "t1", 2.0), (None, "t1", 1.0), ("c00", None, 1.0)]
    post = spark.createDataFrame(rows, "chunk_id string, term string, weight double")
    qw = spark.createDataFrame([(q, f"t{(q or 0) * 3 + j}", 1.0 + j) for q in (0, 1, 2, None) for j in range(6)] + [(1, "t4", 5.0), (1, None, 1.0)], "qid long, term string, qweight double")
    want = {(r.qid, r.chunk_id): r.s for r in post.join(qw, "term").groupBy("qid", "chunk_id").agg(F.sum(F.col("qweight") * F.col("weight")).alias("s")).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for parts in (post.coalesce(1), post.repartition(3)):
            for block, some in ((4000, 10 ** 6), (1, 3)):
                lx.SPARSE_BLOCK, keep = block, lx.SPARSE_BLOCK
                got = {(r.qid, r.chunk_id): (r.score, r["rank"]) for r in lx.lexical_search(qw, parts, some).collect()}
                lx.SPARSE_BLOCK = keep
                assert all(s == want[x] for x, (s, _) in got.items()) and (some == 3 or got.keys() == want.keys())
                for q in (0, 1, 2, None):
                    best = sorted(((-s, c is not None, c or "") for (a, c), s in want.items() if a == q))[:3]
                    assert [c or None for _, _, c in best] == [c for (a, c), (_, r) in sorted(got.items(), key=lambda x: x[1][1]) if a == q and r <= 3]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    lists = lx._runs(post.orderBy("chunk_id").coalesce(1), lx.term_filter(spark.sql("SELECT array('t1', 't2', 't3', 't4', 't5') AS terms")), "chunk_id")
    assert lists.count() <= 50


def test_blocks_are_scored_in_cells_of_many_blocks():
    """Rows of blocks that a query does not name are not its hits, whichever way the scores are made."""
    from sift.operators.block_max import _BlockTopK
    queries, corpus = term_rows(12, 9, 4), term_rows(300, 9, 5)
    ids, block = np.random.default_rng(6).permutation(300), np.arange(300) // 16
    named = [sorted(np.random.default_rng(j).choice(19, 5, replace=False).tolist()) for j in range(12)]
    lists = lambda rows: pa.array(rows, pa.list_(pa.int64()))
    top = _BlockTopK(3, "", False)
    top.add_queries(pa.array(range(12)), [*columns(queries), lists(named)])
    top.add_rows(top.rows([(ids[a:a + 40], [*columns(corpus[a:a + 40]), lists(block[a:a + 40, None].tolist())]) for a in range(0, 300, 40)]))
    for j in range(12):
        on = np.flatnonzero(np.isin(block, named[j]))
        want = brute([queries[j]], [corpus[i] for i in on], ids[on].tolist(), 3)[0]
        assert list(zip(top.best[2][top.best[0] == j], top.best[3][top.best[0] == j])) == want


def test_rows_that_no_tombstone_can_name_are_not_shuffled(spark, tmpdir_fresh):
    from sift.operators import segments as S
    rows = spark.range(500).selectExpr("IF(id % 50 = 0, NULL, concat('s', id % 100)) AS source", "id")
    ids = spark.createDataFrame([("s3",), ("s4",), (None,)], "source string")
    hit, rest = (R.likely_hits(rows, ids, "source", others=x).collect() for x in (False, True))
    assert len(hit) + len(rest) == 500 and not {"s3", "s4", None} & {r.source for r in rest} and len(rest) > 400
    assert R.likely_hits(rows, ids.where("false"), "source", others=True).count() == 500
    chunks = spark.range(200).selectExpr("concat('s', id % 20) AS source", "concat('c', id) AS chunk_id", "concat('word', id % 7, ' other', id) AS content")
    S.add_segment(chunks, tmpdir_fresh, 0)
    S.add_segment(chunks.where("source = 's1'"), tmpdir_fresh, 1)
    live = S.live_postings(spark, tmpdir_fresh, S._schema_of(spark, tmpdir_fresh))
    assert live.count() == 200
    plan = live._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join LeftOuter") == 2  # with the tombstones, and with the bits of the others
    whole = {r.term: (r.cf, r.df) for r in S.index_stats(spark, tmpdir_fresh).collect()}
    some = {r.term: (r.cf, r.df) for r in S.index_stats(spark, tmpdir_fresh, spark.createDataFrame([("word1",), ("none",)], "term string")).collect()}
    assert some["word1"] == whole["word1"] and some[None] == whole[None] == (600, 200) and len(some) < 5
