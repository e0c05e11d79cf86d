"""Operator 2: license scan by diagonal voting.

Rolling word k-grams of every document are joined, as hashes, to the positions
of the same k-grams in the templates.  A hit votes for the diagonal (word
position in the text minus position in the template); votes are summed by
diagonal, neighbouring diagonals of a template are merged (insertions and
deletions of a few words), and spans are verified: each hit compares its words
with the template's, a base phrase needs every one of its k-grams on one
diagonal, and a license text needs ``MIN_COVER`` of its k-grams on merged ones.

Defined results: null text is empty; a document without words or hits has
n_base 0, null places, empty labels and score 0; repeated rows get a row each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import textkit as tk
from .flow import prepare

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Passages of public license texts, for labels of the method's own.
PASSAGES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                "documentation files the software to deal in the software without restriction including without limitation the "
                "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                "following conditions are met redistributions of source code must retain the above copyright notice this list of "
                "conditions and the following disclaimer",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                   "the license you may obtain a copy of the license at",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                "license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc-by-text": "you are free to share copy and redistribute the material in any medium or format and adapt remix transform and "
                  "build upon the material for any purpose even commercially you must give appropriate credit provide a link to the "
                  "license and indicate if changes were made",
}
K_BASE, K_TEXT = 2, 4
MERGE_GAP, MIN_COVER = 3, 0.5
_SELF = 0x5E1F  # the gram with which each document votes for itself, so that none is lost in the join


def template_grams() -> list[tuple[int, str, int, int, int, str]]:
    """(gram hash, template, is base, k, position in the template, the gram's words)."""
    rows = [(_SELF, "", -1, 0, 0, "")]
    for base, k, texts in ((1, K_BASE, BASE), (0, K_TEXT, PASSAGES)):
        for name, text in texts.items():
            phrase = name if base else text
            data, off = tk.text_bytes(pa.array([phrase]))
            start, end, doc = tk.words(data, off, tk.ALNUM_SEP)
            _, g = tk.grams(tk.span_hash(data, start, end, lower=True), doc, k)
            ws = phrase.split()
            rows += [(int(x), name, base, k, i, " ".join(ws[i:i + k])) for i, x in enumerate(tk.signed(g).tolist())]
    return rows


def _rolling(batches):
    """doc_id, text -> doc_id, text, n_words, word starts and ends (bytes), hashes (self, 2-grams, 4-grams), number of 2-grams."""
    for batch in batches:
        data, off = tk.text_bytes(batch.column(2))
        for i, j in tk.slices(off):
            own, at = tk.cut(data, off, i, j)
            n = j - i
            start, end, doc = tk.words(own, at, tk.ALNUM_SEP)
            h = tk.span_hash(own, start, end, lower=True)
            parts = [(np.full(n, _SELF, np.int64), np.arange(n))]
            for k in (K_BASE, K_TEXT):
                ix, g = tk.grams(h, doc, k)
                parts.append((tk.signed(g), doc[ix]))
            owner = np.concatenate([p[1] for p in parts])
            by = np.argsort(owner, kind="stable")
            grams = np.concatenate([p[0] for p in parts])[by]
            count = np.bincount(owner, minlength=n)
            words = np.bincount(doc, minlength=n)
            w_off = np.concatenate([[0], np.cumsum(words)])
            base = at[doc]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), batch.column(1).slice(i, n), batch.column(2).slice(i, n), pa.array(words.astype(np.int64)),
                 tk.list_array((start - base).astype(np.int32), w_off), tk.list_array((end - base).astype(np.int32), w_off),
                 tk.list_array(grams, np.concatenate([[0], np.cumsum(count)])), pa.array(np.bincount(parts[1][1], minlength=n).astype(np.int32))],
                ["_row", "doc_id", "_text", "n_words", "_start", "_end", "_grams", "_pairs"])


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per verified hit (and one per document for itself): row, doc_id, n_words, template, base, place, tpos."""
    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    rolled = src.mapInArrow(_rolling, f"_row long, doc_id {kind}, _text string, n_words long, _start array<int>, _end array<int>, _grams array<long>, _pairs int")
    templates = spark.createDataFrame(template_grams(), "gram long, template string, base int, k int, tpos int, words string")  # fixed size
    hits = (rolled.select("*", F.posexplode("_grams").alias("_i", "gram")).join(F.broadcast(templates), "gram")
            .withColumn("place", F.when(F.col("base") == -1, 0).when(F.col("base") == 1, F.col("_i") - 1).otherwise(F.col("_i") - 1 - F.col("_pairs"))))
    first = F.element_at("_start", F.col("place") + 1)
    span = F.substring(F.col("_text").cast("binary"), first + 1, F.element_at("_end", F.col("place") + F.col("k")) - first).cast("string")
    low = F.translate(span, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    same = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ") == F.col("words")
    return hits.where((F.col("base") == -1) | same).select("_row", "doc_id", "n_words", "template", "base", "place", "tpos")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every document.

    ``spans`` are the method's own: (label, first word, last word, cover) of merged license texts.
    """
    prepare(docs.sparkSession)
    label = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])
    need = F.create_map(*[F.lit(x) for p in BASE for x in (p, len(p.split()) - K_BASE + 1)])
    size = F.create_map(*[F.lit(x) for n, t in PASSAGES.items() for x in (n, len(t.split()) - K_TEXT + 1)])
    rows = votes(docs, id_col, text_col).withColumn("diagonal", F.col("place") - F.col("tpos"))
    diagonals = rows.groupBy("_row", "doc_id", "n_words", "template", "base", "diagonal").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    w = W.partitionBy("_row", "template").orderBy("diagonal")
    merged = (diagonals.withColumn("_new", F.when((F.col("base") == 0) & (F.col("diagonal") - F.lag("diagonal").over(w) <= MERGE_GAP), 0).otherwise(1))
              .withColumn("_run", F.sum("_new").over(w))
              .groupBy("_row", "doc_id", "n_words", "template", "base", "_run")
              .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("diagonal")))
    cover = F.least(F.lit(1.0), F.col("n") / size[F.col("template")])
    is_base = (F.col("base") == 1) & (F.col("n") == need[F.col("template")])
    is_text = (F.col("base") == 0) & (cover >= MIN_COVER)
    found = F.when(is_base, label[F.col("template")]).when(is_text, F.col("template"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (merged.groupBy("_row", "doc_id", "n_words").agg(
        F.sum(is_base.cast("long")).alias("n_base"), F.min(F.when(is_base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(is_base, label[F.col("template")])).alias("base_labels"), joined(found).alias("labels"),
        F.coalesce(F.max(F.when(is_base, 1.0).when(is_text, cover)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(is_text, F.struct(F.col("template").alias("label"), F.col("lo").cast("long").alias("first_word"),
                                                             (F.col("hi") + K_TEXT - 1).cast("long").alias("last_word"), cover.alias("cover"))))).alias("spans"))
        .drop("_row"))
