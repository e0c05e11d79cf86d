"""Vector search for more queries than a task holds: layout of the cells, bounds of the single-precision pass, vectors of the hits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.operators import retrieval as R

METRICS = ("cosine", "l2", "ip")


def vectors(n, dim, seed):
    """Near and exact copies, zero vectors, whole numbers that tie."""
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 4, size=(n, dim)).astype(float)
    v[::17] = 0.0
    v[5::11] = v[5]
    v[6::13] = v[6] + 1e-7
    return v


def brute(v, ids, q, k, metric):
    d = R._distances(v, q, metric, np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1))
    return [list(ids[np.lexsort((ids, np.round(d[:, j], 9)))[:k]]) for j in range(len(q))]


@pytest.mark.parametrize("metric", METRICS)
def test_bounded_pass_finds_the_rows_of_all_pairs(metric):
    v, q = vectors(9000, 12, 1), vectors(60, 12, 2)
    ids = np.random.default_rng(3).permutation(len(v)) if metric != "l2" else np.array([f"{i:06d}" for i in np.random.default_rng(3).permutation(len(v))])
    import pyarrow as pa
    top = R._TopK(4, metric, False)
    as_list = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    top.add_queries(pa.array(range(len(q))), [as_list(q)])
    for lo in range(0, len(v), 3000):
        top.add_corpus(ids[lo:lo + 3000], [as_list(v[lo:lo + 3000])])
    got = [list(top.best[2][top.best[0] == j]) for j in range(len(q))]
    assert got == brute(v, ids, q, 4, metric)


def test_bound_leaves_out_most_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(8000, 32)), rng.normal(size=(50, 32))
    import pyarrow as pa
    measured = []
    pairs = R._TopK._pairs
    monkeypatch.setattr(R._TopK, "_pairs", lambda self, a, b, c: measured.append(len(c)) or pairs(self, a, b, c))
    top = R._TopK(3, "l2", False)
    as_list = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    top.add_queries(pa.array(range(50)), [as_list(q)])
    top.add_corpus(np.arange(8000), [as_list(v)])
    assert sum(measured) < 50 * 8000 // 50


def test_huge_and_odd_values_are_measured_in_full():
    import pyarrow as pa
    v = np.array([[1e20, 0.0], [0.0, 1e-20], [3.0, 4.0], [1e20, 1e20]])
    top = R._TopK(2, "cosine", False)
    as_list = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    top.add_queries(pa.array([0, 1]), [as_list(v[:2])])
    top.add_corpus(np.arange(4), [as_list(v)])
    assert [list(top.best[2][top.best[0] == j]) for j in range(2)] == brute(v, np.arange(4), v[:2], 2, "cosine")


def test_a_query_is_sent_to_few_cells(spark, monkeypatch):
    """With more queries than a task holds, the cells follow the corpus and the cores, not the shuffle partitions."""
    q = spark.range(300).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    c = spark.range(500).select(F.col("id").alias("chunk_id"), F.array((F.col("id") * 2).cast("double"), F.lit(1.0)).alias("embedding"))
    seen = []
    score = R.score_cells
    monkeypatch.setattr(R, "score_cells", lambda qr, cr, *a, **kw: seen.append(qr.count()) or score(qr, cr, *a, **kw))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        many = {(r.qid, r.chunk_id, r["rank"]) for r in R.semantic_search(q, c, 3, "l2", query_block=100).collect()}
        few = {(r.qid, r.chunk_id, r["rank"]) for r in R.semantic_search(q, c, 3, "l2").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert many == few and len(many) == 900
    assert seen[0] <= 300 * 2 * spark.sparkContext.defaultParallelism


def test_mmr_fetches_vectors_after_the_search(spark, monkeypatch):
    """No vector travels with a candidate; an id that comes twice keeps both of its vectors."""
    asked = []
    search = R.semantic_search
    monkeypatch.setattr(R, "semantic_search", lambda *a, **kw: asked.append(kw.get("carry_vectors", False)) or search(*a, **kw))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.5, 0.9])], "chunk_id long, embedding array<double>")
    got = [(r["pick"], r.chunk_id) for r in R.mmr(q, c, k=5, fetch_k=5, lam=1.0, metric="cosine").orderBy("pick").collect()]
    assert asked == [False] and got == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 1)]


def test_few_other_rows_pass_the_filter_of_hit_ids(spark):
    """All rows of the hits' ids pass, repeated ones too; of the others hardly one."""
    ids = spark.range(0, 3000, 3).select(F.format_string("%020d", "id").alias("chunk_id"))
    rows = spark.range(6000).select(F.format_string("%020d", F.col("id") % 3000).alias("chunk_id"), F.col("id").alias("n"))
    got = {r.n for r in R.likely_hits(rows.union(spark.createDataFrame([(None, -1)], "chunk_id string, n long")), ids).collect()}
    want = {n for n in range(6000) if n % 3000 % 3 == 0}
    assert want <= got and len(got - want) < 20
    assert R.likely_hits(rows, ids.where("false")).count() == 0


def test_later_rows_replace_hits_of_some_queries_only():
    """Queries without new rows keep theirs; a bound follows its query's own k-th row."""
    import pyarrow as pa
    as_list = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    v, q = np.random.default_rng(5).normal(size=(7000, 6)), np.random.default_rng(6).normal(size=(515, 6))
    top = R._TopK(3, "l2", False)
    top.add_queries(pa.array(range(len(q))), [as_list(q)])
    for lo in range(0, len(v), 500):
        top.add_corpus(np.arange(lo, lo + 500), [as_list(v[lo:lo + 500])])
        assert (top.bound == [top.best[1][top.best[0] == j][2] for j in range(len(q))]).all()
    assert [list(top.best[2][top.best[0] == j]) for j in range(len(q))] == brute(v, np.arange(len(v)), q, 3, "l2")


def test_places_of_flags():
    for shape in ((3, 5), (40, 256), (1, 1), (0, 4)):
        flags = np.random.default_rng(7).random(shape) < 0.05
        assert (R._where(flags) == np.flatnonzero(flags)).all()


def test_a_corpus_that_fits_has_one_cell_a_core(spark, monkeypatch):
    """Every query goes to every cell and has k rows from each, so a small corpus has no more cells than cores."""
    q = spark.range(300).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    c = spark.range(500).select(F.col("id").alias("chunk_id"), F.array((F.col("id") * 2).cast("double"), F.lit(1.0)).alias("embedding"))
    seen = []
    score = R.score_cells
    monkeypatch.setattr(R, "score_cells", lambda qr, cr, *a, **kw: seen.append(qr.count()) or score(qr, cr, *a, **kw))
    assert R.semantic_search(q, c, 3, "l2", query_block=100).count() == 900
    assert seen == [300 * spark.sparkContext.defaultParallelism]


def test_string_ids_are_compared_at_equal_distances_only(monkeypatch):
    """Equal rounded distances are ordered by id; the ids of others are not sorted."""
    import pyarrow as pa
    as_list = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    rng = np.random.default_rng(8)
    v, q = rng.normal(size=(3000, 5)), rng.normal(size=(20, 5))
    v[1::2] = v[::2]  # pairs of copies
    v[5] = np.nan
    ids = np.array([f"{i:06d}" for i in rng.permutation(len(v))])
    top = R._TopK(5, "l2", False)
    top.add_queries(pa.array(range(len(q))), [as_list(q)])
    for lo in range(0, len(v), 1000):
        top.add_corpus(ids[lo:lo + 1000], [as_list(v[lo:lo + 1000])])
    assert [list(top.best[2][top.best[0] == j]) for j in range(len(q))] == brute(v, ids, q, 5, "l2")

    plain = rng.normal(size=(500, 5))
    other = R._TopK(5, "l2", False)
    other.add_queries(pa.array(range(len(q))), [as_list(q)])
    sorted_ids = []
    lexsort = np.lexsort
    monkeypatch.setattr(R.np, "lexsort", lambda keys, *a, **kw: sorted_ids.extend(len(x) for x in keys if x.dtype.kind == "U") or lexsort(keys, *a, **kw))
    other.add_corpus(ids[:500], [as_list(plain)])
    assert sum(sorted_ids) == 0


def test_mmr_takes_the_vectors_it_is_given(spark, monkeypatch):
    """With ``fetch`` the corpus is read for the search only; the picks are the same."""
    rng = np.random.default_rng(9)
    q = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(6)], "qid long, embedding array<double>")
    c = spark.createDataFrame([(i % 70, rng.random(4).tolist()) for i in range(80)], "chunk_id long, embedding array<double>")
    rows = lambda df: sorted((r.qid, r.pick, r.chunk_id) for r in df.collect())
    want = rows(R.mmr(q, c, k=3, fetch_k=6))
    asked = []
    monkeypatch.setattr(R, "likely_hits", lambda *a: 1 / 0)
    got = rows(R.mmr(q, c, k=3, fetch_k=6, fetch=lambda ids: asked.append(ids.count()) or c.join(ids, "chunk_id")))
    assert got == want and len(asked) == 1 and len(want) == 18


def test_flan_request_reads_the_corpus_for_the_search_and_once_for_its_candidates(spark, tmpdir_fresh, monkeypatch):
    from sift.plans import q_conv
    talk = [(c, t, r, f"{r} {c} asks about shoe size {t}") for c in range(3) for t, r in enumerate(("user", "assistant") * 2)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmpdir_fresh}/conversations.parquet")
    chunks = spark.createDataFrame([(f"{i:03d}", f"shoe number {i} of size {i % 4}", f"/a/{i % 5}.txt") for i in range(60)], "chunk_id string, content string, source string")
    asked = []
    monkeypatch.setattr(q_conv, "likely_hits", lambda rows, ids: asked.append(1) or R.likely_hits_(rows, ids))
    monkeypatch.setattr(R, "likely_hits_", R.likely_hits, raising=False)
    monkeypatch.setattr(R, "likely_hits", lambda *a: 1 / 0)
    got = q_conv.run_request_table(spark, tmpdir_fresh, "flan", chunks).collect()
    assert len(got) == 6 and all(r.n_docs == 4 and r.sources for r in got) and len(asked) == 1


def test_corpus_vectors_are_not_made_to_count_them(spark, monkeypatch):
    """With a table that is cheaper to count the cells are the same and the vectors are made once."""
    q = spark.range(300).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    made = spark.sparkContext.accumulator(0)

    def vectors_of(batches):
        for b in batches:
            made.add(len(b))
            yield b.assign(embedding=[[2.0 * i, 1.0] for i in b["chunk_id"]])

    rows = spark.range(500).withColumnRenamed("id", "chunk_id")
    c = rows.mapInPandas(vectors_of, "chunk_id long, embedding array<double>")
    monkeypatch.setattr(R, "HELD_VALUES", 100)
    hits = R.semantic_search(q, c, 3, "l2", query_block=100, sized=(rows, 2))
    assert made.value == 0
    assert hits.count() == 900 and made.value == 500
