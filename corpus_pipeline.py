"""Corpus pipeline: quality classifier, near-duplicate join, substring dedup, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sift.llm.flow import documents
from sift.llm.near_sets import jaccard_components
from sift.llm.packing import pack
from sift.llm.pii import mask
from sift.llm.quality import classify_quality
from sift.llm.suffix_dedup import remove_repeats


NEAR_WORDS, NEAR_PERCENT = 5, 80  # shingles of five words, similarity of 0.8 or more; op7 has its own contract


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null and empty texts by the same rule; columns stay as they are."""
    names = docs.columns
    own = {c: f"d{k}" for k, c in enumerate(names)}  # extra columns may have any name
    judged = classify_quality(docs.toDF(*own.values()), documents(spark, sf_dir, "labels"), list(own.values()),
                              own["doc_id"], own["text"], own["source"], own["lang"])
    return judged.where("kept").select(*own.values()).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (none: last), once if its row is repeated.

    A document is an id, or none, with its text: rows with one id and different
    texts are documents of their own (nodes are 64-bit hashes of both).
    Documents without words link with nothing and stay, as do their repeats.
    """
    names = docs.columns
    own = {c: f"d{k}" for k, c in enumerate(names)}  # extra columns may have any name
    doc_id, text = own["doc_id"], own["text"]
    d = docs.toDF(*own.values()).withColumn("node", F.xxhash64(doc_id, text))
    found = jaccard_components(d.select("node", text), k=NEAR_WORDS, percent=NEAR_PERCENT, id_col="node", text_col=text)
    nodes = (found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("node"))
             .agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    groups = nodes.where("component_id <> node").select("component_id").distinct()
    members = nodes.join(groups, "component_id").join(d.select("node", doc_id).distinct(), "node")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col(doc_id).isNull(), doc_id, "node"))["node"].alias("first"))
    drop = members.join(first, "component_id").where("node <> first").select("node")
    copies = nodes.where("n > 1").select("node")
    stay = d.join(drop, "node", "left_anti")
    again = stay.join(copies, "node", "left_semi").dropDuplicates(["node"])
    kept = stay.join(copies, "node", "left_anti").unionByName(again)
    return kept.select(*own.values()).toDF(*names)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat in 200-byte strings go from the texts; null and shorter texts stay, other columns too."""
    return remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 at most: a row per piece; a null or empty text is one piece, the end id alone."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", substrings),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and reread as the next one's documents."""
    from sift.session import scratch_path

    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
