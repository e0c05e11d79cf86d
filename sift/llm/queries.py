"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations


from . import collocations as phrases, max_sketch, mixing
from .flow import documents
from .hash_tree import hash_tree_shards
from .licenses import scan_licenses
from .near_sets import jaccard_components
from .packing import pack
from .pii import report
from .quality import classify_quality
from .rules import quality_rules
from .stable_lsh import near_duplicates
from .suffix_dedup import dedup_report
from .wfst import encode_documents


def op1_quality_classifier(spark, sf_dir):
    d = documents(spark, sf_dir)
    return classify_quality(d, documents(spark, sf_dir, "labels"), ["doc_id"])


def op2_license_diagonals(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


def op3_skip_chain_pii(spark, sf_dir):
    return report(documents(spark, sf_dir))


def op4_hash_tree(spark, sf_dir):
    return hash_tree_shards(documents(spark, sf_dir), 24)


def op5_suffix_dedup(spark, sf_dir):
    return dedup_report(documents(spark, sf_dir))


def op6_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


def op8_stable_lsh(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op10_sentencepiece_wfst(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir))


def op11_max_sketch_search(spark, sf_dir):
    return max_sketch.lexical_search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


def op13_source_mix(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_license_diagonals, op3_skip_chain_pii, op4_hash_tree, op5_suffix_dedup, op6_quality_rules, op7_ngram_jaccard, op8_stable_lsh, op9_best_fit_packing,
    op10_sentencepiece_wfst, op11_max_sketch_search, op12_phrase_collocations, op13_source_mix)}
ORACLE = {"op11_max_sketch_search": max_sketch.ORACLE_SQL, "op12_phrase_collocations": phrases.ORACLE_SQL, "op13_source_mix": mixing.ORACLE_SQL}
