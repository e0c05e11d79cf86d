"""E2-E4, F5, G1-G4 with lexicons as tables: one automaton over all patterns.

A lexicon is a table of patterns, as long as need be.  ``matched`` finds every
pattern that is a substring of a text by a multi-pattern automaton, built once
per Python worker and run over whole Arrow batches: the cost of a text does not
depend on the number of patterns and the plan holds one node instead of one
comparison per pattern.  The patterns go to the tasks as a broadcast; a lexicon of
more than ``LEXICON_BYTES`` is an error (look-ups in larger ones are joins).

On top of it: ``classify_by`` (E3: the matching pattern of lowest priority
wins), ``terms_by`` (E4: heads found by any of their patterns), ``contains_by``
(E2, G1-G4: is any pattern found) and ``filter_lines_by`` (F5).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..session import ship_package

LEXICON_BYTES = 64 << 20


class LexiconTooLarge(ValueError):
    pass


def lexicon_rows(lexicon: DataFrame, pattern_col: str, label_col: str) -> list[tuple[str, object]]:
    """Distinct (pattern, label) rows without empty or null patterns, their size checked before they are fetched."""
    rows = lexicon.select(F.col(pattern_col).alias("p"), F.col(label_col).alias("l")).where("length(p) > 0").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("p") + 16), F.lit(0)).alias("n")).first()["n"]  # one number
    if size > LEXICON_BYTES:
        raise LexiconTooLarge(f"the lexicon has {size} bytes; {LEXICON_BYTES} can be sent to the tasks")
    return [(r["p"], r["l"]) for r in rows.collect()]


_built: list = [None, None, False]  # of this worker: the lexicon last seen, its automaton, whether it has patterns


def _automaton(bc):
    import ahocorasick

    rows = bc.value
    if _built[0] is not rows:
        a, labels = ahocorasick.Automaton(), {}
        for pattern, label in rows:
            labels.setdefault(pattern, []).append(label)
        for pattern, own in labels.items():
            a.add_word(pattern, own)
        if labels:
            a.make_automaton()
        _built[:] = [rows, a, bool(labels)]
    return _built[1], _built[2]


def matched(df: DataFrame, text: Column, lexicon: DataFrame, out: str = "labels", pattern_col: str = "pattern", label_col: str = "label") -> DataFrame:
    """``df`` with ``out``: the distinct labels (sorted) of the patterns that are substrings of ``text``; null text: none."""
    spark = df.sparkSession
    ship_package(spark)
    kind = lexicon.schema[label_col].dataType
    bc = spark.sparkContext.broadcast(lexicon_rows(lexicon, pattern_col, label_col))
    src = df.withColumn(out, F.coalesce(text, F.lit("")))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, T.ArrayType(kind))]) if out not in df.columns else None
    if schema is None:
        raise ValueError(f"there is a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, any_words = _automaton(bc)
        for rb in batches:
            found = []
            for t in rb.column(rb.num_columns - 1).to_pylist():
                hits = {x for _, own in automaton.iter(t) for x in own} if any_words and t else ()
                found.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(found, pa.list_(_arrow(kind)))], names=rb.schema.names)

    return src.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def classify_by(df: DataFrame, text_col: str, patterns: DataFrame, out: str = "query_type", default: str = "general") -> DataFrame:
    """``patterns`` (priority, query_type, pattern); the class of the lowest priority that matches the lower-cased text."""
    names = patterns.groupBy("priority").agg(F.min("query_type").alias("query_type"))
    ranked = matched(df, F.lower(F.col(text_col)), patterns, "_priorities", "pattern", "priority")
    best = ranked.withColumn("_best", F.array_min("_priorities")).drop("_priorities")
    named = best.join(names.withColumnRenamed("query_type", out), F.col("_best") == F.col("priority"), "left")
    return named.withColumn(out, F.coalesce(out, F.lit(default))).drop("_best", "priority")


def terms_by(df: DataFrame, text_col: str, lexicon: DataFrame, out: str = "retail_terms") -> DataFrame:
    """``lexicon`` (head, synonym); heads found in the lower-cased text directly or by a synonym, sorted."""
    own = lexicon.select("head", F.col("head").alias("pattern")).unionByName(lexicon.select("head", F.col("synonym").alias("pattern")))
    return matched(df, F.lower(F.col(text_col)), own, out, "pattern", "head")


def contains_by(df: DataFrame, text_col: str, lexicon: DataFrame, out: str, lower: bool = True, pattern_col: str = "pattern") -> DataFrame:
    """Is any pattern a substring of the text (lower-cased, or as it is)."""
    text = F.lower(F.col(text_col)) if lower else F.col(text_col)
    found = matched(df, text, lexicon.select(pattern_col, F.lit(1).alias("_one")), "_found", pattern_col, "_one")
    return found.withColumn(out, F.size("_found") > 0).drop("_found")


def filter_lines_by(df: DataFrame, text_col: str, skip: DataFrame, out: str, sep: str = "\n", shortest: int = 4, pattern_col: str = "pattern") -> DataFrame:
    """stripped lines of at least ``shortest`` characters without a skip pattern (lower-cased), joined by ``sep``."""
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(lexicon_rows(skip, pattern_col, pattern_col))
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), py_strip)
    src = df.withColumns({"_lines": lines, "_low": F.transform(lines, F.lower)})
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_keep", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, any_words = _automaton(bc)
        for rb in batches:
            low = rb.column(rb.num_columns - 1)
            flat = [not (any_words and t and next(automaton.iter(t), None)) for t in low.flatten().to_pylist()]
            ends = np.concatenate([[0], np.cumsum(np.asarray(low.value_lengths()))]).astype(np.int32)
            keep = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], keep], names=[*rb.schema.names[:-1], "_keep"])

    kept = F.filter(F.arrays_zip("_lines", "_keep"), lambda x: x["_keep"] & (F.length(x["_lines"]) >= shortest))
    return src.mapInArrow(run, schema).withColumn(out, F.array_join(F.transform(kept, lambda x: x["_lines"]), sep)).drop("_lines", "_keep")
