"""Operator 11: ranked lexical search by hashed max-sketches.

Index, one row per document, from one reading of the texts: its term hashes
and frequencies, and a sketch of ``SLOTS`` bytes.  A term belongs to two slots
and a slot holds the largest frequency of its terms (255: that or more).  The
impact of a term rises with its frequency in the document, so the slots' maxima
give the largest impact that any term of a slot can have; they are kept as
frequencies since impacts need the statistics of the whole collection.

Search, for blocks of queries:

1. All terms of a block are looked up in a batch of sketches at once; the lesser
   of a term's two slots bounds its impact, and one matrix product bounds the
   score of every document for every query.
2. Each query's ``k`` documents with the highest bounds are scored exactly; the
   least of these scores is a threshold that the answer cannot fall below.
3. Documents are scored exactly by descending bound until the bound falls below
   the threshold, which rises as a task finds better documents.

Scores are 64-bit integers and exact; the sketch decides only what is skipped.

Defined results: null and empty texts have no terms and are found by no query;
queries without known terms have no rows; rows equal in score rank by id, null
last; repeated documents are documents of their own; queries equal in id and text
are one query, those with one id and different texts are ranked apart; empty
tables give an empty result; extra columns are ignored; ids keep their type.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import textkit as tk
from .flow import Stage, null_safe

K, SLOTS = 20, 2048
QUERY_BLOCK = 512          # queries of a block at most
MATRIX = 1 << 20           # cells of a working matrix (documents x terms) at most
_SLACK = 1.0 + 1e-5        # bounds are single precision sums


def _slots(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(SLOTS.bit_length() - 1)
    return (term >> (np.uint64(64) - bits)).astype(np.int64), ((term >> (np.uint64(64) - 2 * bits)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _term_counts(data: np.ndarray, off: np.ndarray):
    """Distinct terms by document: (document, term, tf)."""
    start, end, doc = tk.words(data, off, tk.ALNUM_SEP)
    h = tk.span_hash(data, start, end, lower=True)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def sketches(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int) -> np.ndarray:
    out = np.zeros((n_docs, SLOTS), np.uint8)
    for slot in _slots(term):
        np.maximum.at(out, (doc, slot), np.minimum(tf, 255).astype(np.uint8))
    return out


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    cut = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cut), pa.py_buffer(values.tobytes())])


def _index_rows(batches):
    for batch in batches:
        data, off = tk.text_bytes(batch.column(1))
        for i, j in tk.slices(off):
            doc, term, tf = _term_counts(*tk.cut(data, off, i, j))
            ends = np.cumsum(np.bincount(doc, minlength=j - i))
            n = tk.per_doc(doc, j - i, tf)
            sketch = sketches(doc, term, tf, j - i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n), _binary(term, ends), _binary(tf.astype(np.uint32), ends),
                 _binary(sketch.ravel(), np.arange(1, j - i + 1) * SLOTS)], ["id", "n", "terms", "tf", "sketch"])


def _document_frequencies(batches):
    for batch in batches:
        term, df = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tk.signed(term)), pa.array(df)], ["term", "df"])


class Index(NamedTuple):
    rows: DataFrame      # row, id, n, terms, tf, sketch
    terms: DataFrame     # term, df
    n_docs: int          # documents with a term
    length: int          # all terms with repeats


def build_index(st: Stage, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    src = docs.select(F.col(id_col).alias("id"), null_safe(F.col(text_col)).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = src.mapInArrow(_index_rows, f"id {kind}, n long, terms binary, tf binary, sketch binary").where("n > 0")
    rows = st.keep(rows.withColumn("row", F.monotonically_increasing_id()), "index")  # written with its numbers
    terms = st.keep(rows.select("terms").mapInArrow(_document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()  # two numbers
    return Index(rows, terms, total["n"], total["l"])


class Block:
    """Queries of one block: distinct terms and their weights by query."""

    def __init__(self, entries: list, n_docs: int, length: int):
        """``entries``: (query number, term, occurrences in the query, df)."""
        self.n_docs, self.length = n_docs, length
        self.terms, at = np.unique(np.array([e[1] for e in entries], np.int64).view(np.uint64), return_inverse=True)
        self.n = 1 + max(e[0] for e in entries)
        w = np.array([e[2] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * e[3] + 1))) for e in entries], np.int64)
        q = np.array([e[0] for e in entries], np.int64)
        self.of = [(at[q == k], w[q == k]) for k in range(self.n)]
        self.weights = np.zeros((len(self.terms), self.n), np.float32)
        self.weights[at, q] = w
        self.slots = _slots(self.terms)
        self.tile = max(1, MATRIX // len(self.terms))

    def norm(self, n: np.ndarray) -> np.ndarray:
        """12 m of documents with n terms; the product may pass 64 bits."""
        if 25 * int(n.max(initial=0)) * self.n_docs < 2 ** 63:
            return 12 * (75 + 25 * n * self.n_docs // self.length)
        return np.array([12 * (75 + 25 * x * self.n_docs // self.length) for x in n.tolist()], np.int64)

    def bounds(self, sketch: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Documents x queries upper bounds of the scores."""
        tf = np.minimum(sketch[:, self.slots[0]], sketch[:, self.slots[1]]).astype(np.float32)
        impact = np.float32(1e9) * tf / (np.float32(1000) * tf + norm[:, None].astype(np.float32))
        impact[tf == 255] = 1e6  # 255 stands for any larger frequency
        return (impact @ self.weights) * np.float32(_SLACK) + 1

    def impacts(self, terms: list[bytes], tf: list[bytes], norm: np.ndarray) -> np.ndarray:
        """Documents x terms exact impacts."""
        size = np.array([len(t) // 8 for t in terms], np.int64)
        term, count = np.frombuffer(b"".join(terms), np.uint64), np.frombuffer(b"".join(tf), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(terms)), size)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        on = self.terms[at] == term
        out = np.zeros((len(terms), len(self.terms)), np.int64)
        out[doc[on], at[on]] = 1_000_000_000 * count[on] // (1000 * count[on] + norm[doc[on]])
        return out

    def scores(self, impacts: np.ndarray, rows: np.ndarray, q: int) -> np.ndarray:
        at, w = self.of[q]
        return impacts[rows[:, None], at[None, :]] @ w

    def tiles(self, batch, names: list[str]):
        """(first row, rows, norm, sketches, impacts()) of tiles of a batch."""
        at = {c: i for i, c in enumerate(names)}
        for lo in range(0, batch.num_rows, self.tile):
            part = batch.slice(lo, self.tile)
            norm = self.norm(np.asarray(part.column(at["n"])))
            sketch = np.frombuffer(b"".join(part.column(at["sketch"]).to_pylist()), np.uint8).reshape(-1, SLOTS)
            exact = (lambda p=part, m=norm: self.impacts(p.column(at["terms"]).to_pylist(), p.column(at["tf"]).to_pylist(), m)) if "terms" in at else None
            yield lo, part, norm, sketch, exact


def _highest_bounds(bc, k: int, names: list[str]):
    """The k documents with the highest bounds of each query, by task: (q, row, bound)."""
    def run(batches):
        block = bc.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.float32), np.zeros(0, np.int64))] * block.n
        for batch in batches:
            for _, part, norm, sketch, _ in block.tiles(batch, names):
                bound, row = block.bounds(sketch, norm), np.asarray(part.column(0))
                for q in range(block.n):
                    b, r = np.concatenate([best[q][0], bound[:, q]]), np.concatenate([best[q][1], row])
                    top = np.argpartition(-b, k)[:k] if len(b) > k else np.arange(len(b))
                    best[q] = b[top], r[top]
        q = np.repeat(np.arange(block.n), [len(b) for b, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.concatenate([r for _, r in best])),
                                          pa.array(np.concatenate([b for b, _ in best]).astype(np.float64))], ["q", "row", "bound"])
    return run


def _scored(bc):
    """Exact scores of (n, terms, tf, queries) rows: (q, score)."""
    def run(batches):
        block = bc.value
        for batch in batches:
            for i in range(batch.num_rows):
                n, terms, tf, queries = (batch.column(c)[i].as_py() for c in range(4))
                x = block.impacts([terms], [tf], block.norm(np.array([n])))
                score = np.concatenate([block.scores(x, np.zeros(1, np.int64), q) for q in queries])
                yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int32()), pa.array(score)], ["q", "score"])
    return run


def _order(entry) -> tuple:
    score, ident = entry
    return -score, ident is None, ident if ident is not None else 0


def _descending(bc, floors, k: int, names: list[str]):
    """Each query's k best documents of a task, scored by descending bound until it falls below the threshold."""
    def run(batches):
        block, floor = bc.value, np.array(floors)
        best: list[list] = [[] for _ in range(block.n)]
        for batch in batches:
            for _, part, norm, sketch, exact in block.tiles(batch, names):
                bound = block.bounds(sketch, norm)
                hot = np.flatnonzero((bound >= floor).any(axis=0))
                if len(hot) == 0:
                    continue
                impacts, ids = exact(), part.column(0)
                for q in hot.tolist():
                    rows = np.flatnonzero(bound[:, q] >= floor[q])
                    rows = rows[np.argsort(-bound[rows, q], kind="stable")]
                    for s in range(0, len(rows), 64):
                        some = rows[s:s + 64]
                        some = some[bound[some, q] >= floor[q]]
                        if len(some) == 0:
                            break
                        score = block.scores(impacts, some, q)
                        good = np.flatnonzero(score >= floor[q])
                        if len(good):
                            best[q] = sorted([*best[q], *zip(score[good].tolist(), ids.take(pa.array(some[good])).to_pylist())], key=_order)[:k]
                            if len(best[q]) == k:
                                floor[q] = max(floor[q], best[q][-1][0])
        rows = [(q, s, i) for q, entries in enumerate(best) for s, i in entries]
        if rows:
            q, score, ident = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ident, ids.type), pa.array(score, pa.int64())], ["q", "id", "score"])
    return run


def _ranked(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _search_block(st: Stage, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, id, score) of the queries of one block: (item, key, term, times)."""
    spark = st.spark
    found = queries.join(index.terms, "term").select("item", "key", "term", "times", "df").collect()  # terms of one block
    items = sorted({(r["item"], r["key"]) for r in found}, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))
    number = {x: q for q, x in enumerate(items)}
    item_type, id_type = queries.schema["item"].dataType, index.rows.schema["id"].dataType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", item_type)])
    if not items:
        return index.rows.limit(0).select(F.lit(None).cast(item_type).alias("item_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    bc = spark.sparkContext.broadcast(Block([(number[r["item"], r["key"]], r["term"], r["times"], r["df"]) for r in found], index.n_docs, index.length))

    bounds = index.rows.select("row", "n", "sketch").mapInArrow(_highest_bounds(bc, k, ["row", "n", "sketch"]), "q int, row long, bound double")
    first = _ranked(bounds, ["q"], [F.desc("bound"), "row"], k).groupBy("row").agg(F.collect_list("q").alias("queries"))  # k x block rows at most
    exact = index.rows.join(F.broadcast(first), "row").select("n", "terms", "tf", "queries").mapInArrow(_scored(bc), "q int, score long")
    floors = [1] * len(items)
    for r in exact.where("score > 0").groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).where(F.col("c") >= k).collect():
        floors[r["q"]] = r["s"]

    names = ["id", "n", "terms", "tf", "sketch"]
    best = index.rows.select(names).mapInArrow(_descending(bc, floors, k, names), T.StructType(
        [T.StructField("q", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]))
    named = spark.createDataFrame([(q, x[0]) for x, q in number.items()], schema)
    top = _ranked(best, ["q"], [F.desc("score"), F.col("id").asc_nulls_last()], k)
    return top.join(F.broadcast(named), "q").select("item_id", "rank", "id", "score")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", query_col: str = "text", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with a score above 0."""
    st = Stage(docs.sparkSession, "maxsketch")
    index = build_index(st, docs, id_col, text_col)
    q = queries.select(F.col(item_col).alias("item"), null_safe(F.col(query_col)).alias("text")).distinct()
    kind = q.schema["item"].dataType.simpleString()

    def query_terms(batches):
        for batch in batches:
            doc, term, tf = _term_counts(*tk.text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(tk.signed(term)), pa.array(tf)],
                                             ["item", "key", "term", "times"])

    terms = st.keep(q.withColumn("key", F.xxhash64("text")).mapInArrow(query_terms, f"item {kind}, key long, term long, times long"), "queries")
    n = terms.select("item", "key").distinct().count()
    blocks = 1 if n <= query_block else -(-2 * n // query_block)  # half full, so that none of the hashed blocks is over its bound
    parts = [_search_block(st, index, terms.where(F.pmod(F.xxhash64("item", "key"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = st.hold(out.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))
    st.drop(*list(st.paths))
    return out


ORACLE_SQL = r"""
WITH terms AS (SELECT doc_id, d, unnest(t) AS term, len(t) AS n FROM (
       SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)),
total AS (SELECT count(DISTINCT d)::BIGINT AS nd, count(*)::BIGINT AS l FROM terms),
tfs AS (SELECT doc_id, d, term, any_value(n)::BIGINT AS n, count(*)::BIGINT AS tf FROM terms GROUP BY doc_id, d, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term, nd),
items AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (
       SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
       FROM benchmark) GROUP BY item_id, term),
scores AS (SELECT item_id, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
           FROM items JOIN weights USING (term) JOIN tfs USING (term), total GROUP BY item_id, doc_id, d)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
