"""Stored indexes: inverted file, block-max, segments — against the searches without an index, with counts of what is skipped."""
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.operators.block_max import block_max_search, build_block_index, load_block_index
from sift.operators.ivf import build_ivf, ivf_search, load_ivf
from sift.operators.lexical import bm25_search, build_tfidf, keyword_search
from sift.operators.retrieval import recall_at_k, semantic_search
from sift.operators.segments import add_segment, index_batch, index_stats, merge_segments, segment_search
from sift.plans.inputs import bench_queries, line_chunks

SF = "/root/testdata/sf0.001"


def path():
    return tempfile.mkdtemp(prefix="sift-ix-") + "/ix"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.fixture(scope="module")
def clustered(spark):
    """(chunk_id, embedding) in 40 clusters, one of which holds a third of all rows; zero and repeated vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    label = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 40, 6000))
    v = centres[label] + rng.normal(size=(6000, 16)) * 0.08
    v[10], v[11] = 0.0, v[12]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(6)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_ivf_exact_equals_full_search(spark, clustered, metric):
    index = build_ivf(clustered, path(), 32, metric)
    q = clustered.where("chunk_id % 37 = 0 OR chunk_id IN (10, 11)").select(F.col("chunk_id").alias("qid"), "embedding")
    want = semantic_search(q, clustered, 7, metric)
    got = ivf_search(index, q, 7, probes=2, exact=True)
    cols = ("qid", "rank", F.round("distance", 7)) if metric == "cosine" else ("qid", "rank", "chunk_id", F.round("distance", 7))
    assert rows(got, *cols) == rows(want, *cols)
    assert recall_at_k(ivf_search(index, q.where("qid <> 10"), 7, probes=4), want.where("qid <> 10")).agg(F.avg("recall")).first()[0] >= 0.95


def test_ivf_reads_few_cells_and_splits_hot_ones(spark, clustered, monkeypatch):
    from sift.operators import ivf
    monkeypatch.setattr(ivf, "CELL_ROWS", 100)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", 3)
    where = path()
    build_ivf(clustered, where, 32, "l2")
    index = load_ivf(spark, where)
    q = clustered.where("chunk_id BETWEEN 20 AND 23").select(F.col("chunk_id").alias("qid"), "embedding")
    got = ivf_search(index, q, 5, probes=1, exact=True)
    assert rows(got, "qid", "chunk_id", "rank") == rows(semantic_search(q, clustered, 5, "l2"), "qid", "chunk_id", "rank")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    cells = index.cells.count()
    read = {r["cell"] for r in index.cells.collect()} & {int(x) for line in plan.splitlines() if "PartitionFilters" in line for x in __import__("re").findall(r"cell#\d+ (?:IN \(([\d,]+)\)|= (\d+))", line) for x in ",".join(x).strip(",").split(",")}
    assert 0 < len(read) <= cells // 4


def test_ivf_edges(spark, clustered):
    q = clustered.where("chunk_id < 3").select(F.col("chunk_id").alias("qid"), "embedding")
    empty = build_ivf(clustered.where("false"), path(), 4)
    assert ivf_search(empty, q, 3, exact=True).count() == 0
    small = clustered.where("chunk_id < 5")
    got = ivf_search(build_ivf(small, path(), 8), q, 9, probes=1, exact=True)  # fewer rows than k
    assert rows(got, "qid", "chunk_id", "rank") == rows(semantic_search(q, small, 9, "l2"), "qid", "chunk_id", "rank")
    with pytest.raises(ValueError):
        build_ivf(small, path(), 8, "ip")


def test_corpus_is_shuffled_once_for_many_query_blocks(spark, clustered):
    q = clustered.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    many = semantic_search(q, clustered, 4, "l2", query_block=50)  # twelve blocks
    assert rows(many, "qid", "chunk_id", "rank") == rows(semantic_search(q, clustered, 4, "l2"), "qid", "chunk_id", "rank")
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    corpus = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(corpus) == 1  # only the queries are copied


@pytest.mark.parametrize("scorer", ["bm25", "tfidf"])
def test_block_max_equals_search_over_texts_and_skips(spark, scorer):
    chunks, q = line_chunks(spark, SF), bench_queries(spark, SF)
    where = path()
    build_block_index(chunks, where, scorer, block=8)
    report = {}
    got = block_max_search(load_block_index(spark, where), q, 5, report=report)
    want = bm25_search(q, chunks, 5) if scorer == "bm25" else keyword_search(q, chunks, 5, build_tfidf(chunks)[0])
    cols = ("qid", "chunk_id", "rank", F.round("score", 6))
    assert rows(got, *cols) == rows(want, *cols)
    assert report["scored"] < 0.6 * report["pairs"], report


def test_block_max_edges(spark):
    chunks = spark.createDataFrame([("a", "same words here"), ("b", "same words here"), ("c", None), ("d", ""), ("e", "other")], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "same words"), (2, None), (3, "unknown"), (4, "")], "qid long, text string")
    got = block_max_search(build_block_index(chunks, path(), block=2), q, 3)
    assert rows(got, "qid", "chunk_id", "rank") == [(1, "a", 1), (1, "b", 2)]
    assert block_max_search(build_block_index(chunks.where("false"), path()), q, 3).count() == 0


def versions(spark):
    a = [("s1", "s1:0", "alpha beta gamma"), ("s1", "s1:1", "beta beta"), ("s2", "s2:0", "gamma delta"), (None, "n:0", "alpha alpha")]
    b = [("s3", "s3:0", "alpha delta epsilon"), ("s4", "s4:0", "zeta beta alpha")]
    c = [("s1", "s1:0", "epsilon zeta"), (None, "n:1", "gamma")]          # s1 changed and shorter
    d = [("s1", "s1:0", "epsilon zeta alpha beta"), ("s5", "s5:0", "")]   # and again
    return [spark.createDataFrame(x, "source string, chunk_id string, content string") for x in (a, b, c, d)]


def test_segments_equal_a_rebuild(spark):
    where, parts = path(), versions(spark)
    for seg, part in enumerate(parts):
        add_segment(part, where, seg)
        add_segment(part, where, seg)  # a replay changes nothing
    add_segment(parts[0].where("false"), where, 9, removed=spark.createDataFrame([("s2",), ("unknown",)], "source string"))
    live = parts[0].where("source IS NULL").unionByName(parts[1]).unionByName(parts[2].where("source IS NULL")).unionByName(parts[3])
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma zeta epsilon"), (3, "delta"), (4, None)], "qid long, text string")
    cols = ("qid", "chunk_id", "rank", F.round("score", 9))
    want = rows(bm25_search(q, live, 5), *cols)
    assert rows(segment_search(spark, where, q, 5), *cols) == want
    total = index_stats(spark, where).where("term IS NULL").first()
    assert total["df"] == live.count()
    merged = path()
    merge_segments(spark, where, merged)
    assert rows(segment_search(spark, merged, q, 5), *cols) == want
    add_segment(parts[0].where("source = 's2'"), merged, 1)  # a merged index grows on
    assert (3, "s2:0") in rows(segment_search(spark, merged, q, 5), "qid", "chunk_id")


def test_segments_from_a_stream(spark):
    src, where = tempfile.mkdtemp(prefix="sift-src-"), path()
    for i, part in enumerate(versions(spark)):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        stream.writeStream.foreachBatch(index_batch(where)).option("checkpointLocation", where + "-ckpt").trigger(availableNow=True).start().awaitTermination()
    live = versions(spark)
    live = live[0].where("source IS NULL OR source = 's2'").unionByName(live[1]).unionByName(live[2].where("source IS NULL")).unionByName(live[3])
    q = spark.createDataFrame([(1, "alpha beta zeta")], "qid long, text string")
    assert rows(segment_search(spark, where, q, 9), "chunk_id", "rank") == rows(bm25_search(q, live, 9), "chunk_id", "rank")
