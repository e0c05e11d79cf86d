"""Keyword index (TF-IDF postings) and keyword search.

The index is never a matrix.  It is two tables:

* ``vocab(term, cf, df, idf)`` — at most ``max_features`` rows, chosen by
  corpus term count (ties: term ascending);
* ``postings(chunk_id, term, tf, weight)`` — tf-idf weights, L2-normalised
  per chunk.

``save_index`` / ``load_index`` keep both as Parquet.  Term analysis: lower-case,
tokens of two or more word characters (a SQL expression), stop words removed,
then unigrams + bigrams of what is left.  A chunk is one row, so its terms,
counts, length and norm are made in the Arrow batch that holds it: nothing is
shuffled before ``groupBy(term)``, and that is pre-summed by batch.

Keyword search from texts (``keyword_search``, ``bm25_search``) scores a chunk
where its row is, against blocks of queries, and keeps a running top ``k`` (the
block join of vector retrieval).  ``lexical_search`` works on a stored index and
does the same with the postings, which are put together by chunk again.
"""

from __future__ import annotations

import math
import zlib
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.stop_words import STOP_WORDS
from ..functions.text import word_tokens
from ..session import ship_package
from .retrieval import _SparseTopK, block_join

MAX_FEATURES = 5000
SPARSE_BLOCK = 4000      # queries held by a task at most
RANK_DECIMALS = 9
COUNTERS = 400_000       # terms of a task's summary at most
CANDIDATES = 200_000     # terms that are counted a second time at most
FILTER_BITS = 24         # log2 of the bits of a query term filter


def _codes(toks: pa.Array, stop: pa.Array, bigrams: bool, keep: Callable | None = None):
    """Distinct terms of every row of a token-list column: (row, term code, tf), the words, the pairs of word codes, and row lengths.

    Codes below the number of words are words, the others pairs.  ``keep`` gives
    flags of the words; terms with another word are left out (not of the lengths).
    """
    n = len(toks)
    size = np.asarray(toks.value_lengths().fill_null(0)).astype(np.int64)
    enc = toks.flatten().dictionary_encode()
    code = np.asarray(enc.indices).astype(np.int64)
    used = ~np.asarray(pc.is_in(enc.dictionary, value_set=stop)) if len(code) else np.zeros(0, bool)
    words: list[str] = enc.dictionary.filter(pa.array(used, pa.bool_())).to_pylist()
    on = used[code]
    row, code = np.repeat(np.arange(n), size)[on], (np.cumsum(used) - 1)[code[on]]
    length = np.bincount(row, minlength=n)
    if bigrams:
        length = length + np.maximum(length - 1, 0)
    base = max(len(words), 1)
    flags = np.ones(len(words), bool) if keep is None else keep(words)
    mine = flags[code]
    rows, codes, pairs = [row[mine]], [code[mine]], np.zeros(0, np.int64)
    if bigrams and len(code) > 1:
        pair = np.flatnonzero((row[1:] == row[:-1]) & mine[1:] & mine[:-1])
        pairs, back = np.unique(code[pair] * base + code[pair + 1], return_inverse=True)
        rows.append(row[pair])
        codes.append(back + len(words))
    total = max(len(words) + len(pairs), 1)
    key = np.sort(np.concatenate(rows) * total + np.concatenate(codes))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    row, code = key[first] // total, key[first] % total
    return row, code, np.diff(np.append(first, len(key))).astype(np.int64), words, (pairs // base, pairs % base), length.astype(np.int64)


def _terms(toks: pa.Array, stop: pa.Array, bigrams: bool, keep: Callable | None = None):
    """The same with the terms by code instead of words and pairs."""
    row, code, tf, words, (a, b), length = _codes(toks, stop, bigrams, keep)
    return row, code, tf, words + [f"{words[x]} {words[y]}" for x, y in zip(a.tolist(), b.tolist())], length


def _words_of(terms: Iterable[str]) -> Callable:
    """Flags of the words that some of the terms are made of."""
    known = {w for t in terms for w in t.split(" ")}
    return lambda words: np.fromiter((w in known for w in words), bool, len(words))


def _token_lists(df: DataFrame, cols: Sequence[str], text_col: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.select(*cols, word_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_toks"))


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = STOP_WORDS,
                bigrams: bool = True) -> DataFrame:
    """``(id, term, tf, length)`` — one row per distinct term of a row, ``length`` its number of terms.  No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(list(stop_words), pa.string())
        for rb in batches:
            row, code, tf, names, length = _terms(rb.column(1), stop, bigrams)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(code)), pa.array(tf), pa.array(length[row])],
                names=[id_col, "term", "tf", "length"])

    src = _token_lists(df, [id_col], text_col)
    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, term string, tf long, length long")


def term_stats(df: DataFrame, text_col: str, stop_words: Sequence[str] = STOP_WORDS, bigrams: bool = True, only: list[str] | None = None) -> DataFrame:
    """``(term, cf, df)`` over all rows, or ``only`` of some terms, pre-summed by batch; the null term has the number of terms (cf) and of rows (df)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(list(stop_words), pa.string())
        keep = None if only is None else _words_of(only)
        for rb in batches:
            _, code, tf, names, length = _terms(rb.column(0), stop, bigrams, keep)
            if only is not None:
                new = np.cumsum(own := np.asarray(pc.is_in(pa.array(names, pa.string()), value_set=pa.array(only, pa.string())))) - 1
                tf, code, names = tf[own[code]], new[code[own[code]]], [t for t, k in zip(names, own.tolist()) if k]
            cf = np.bincount(code, weights=tf, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, None], pa.string()), pa.array(np.append(cf, length.sum())),
                 pa.array(np.append(np.bincount(code, minlength=len(names)), rb.num_rows))], names=["term", "cf", "df"])

    part = _token_lists(df, [], text_col).mapInArrow(run, "term string, cf long, df long")
    return part.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _summaries(counters: int, stop_words: Sequence[str]):
    """Per task a Misra-Gries summary of at most ``counters`` terms: (term, cf, df); the null term has the rows and what
    a term may have lost (cf: terms, df: rows, lost)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(list(stop_words), pa.string())
        ids: dict[str, int] = {}  # numbers of the words; a pair of words a, b has the key (a + 1) << 31 | b
        held = np.zeros((3, 0), np.int64)  # key, cf, df by key
        rows = total = lost = 0
        for rb in batches:
            _, code, tf, words, (a, b), length = _codes(rb.column(0), stop, True)
            own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            n = len(own) + len(a)
            new = np.stack([np.concatenate([own, (own[a] + 1) << 31 | own[b]]), np.bincount(code, weights=tf, minlength=n).astype(np.int64), np.bincount(code, minlength=n)])
            held = np.concatenate([held, new[:, np.argsort(new[0])]], axis=1)
            held = held[:, np.argsort(held[0], kind="stable")]  # two sorted runs
            first = np.flatnonzero(np.append(True, held[0, 1:] != held[0, :-1])) if held.size else np.zeros(0, np.int64)
            held = np.concatenate([held[:1, first], np.add.reduceat(held[1:], first, axis=1)]) if len(first) else held
            rows, total = rows + rb.num_rows, total + int(length.sum())
            if held.shape[1] > counters:
                at = held.shape[1] - 1 - counters // 2
                cut = int(np.partition(held[1], at)[at])
                held = held[:, held[1] > cut]
                held[1] -= cut
                lost += cut
            if len(ids) > 4 * counters:  # words of no held term are forgotten
                names, key = list(ids), held[0]
                one, two = np.where(key >> 31 > 0, (key >> 31) - 1, key), np.where(key >> 31 > 0, key & (1 << 31) - 1, key)
                left = np.unique(np.concatenate([one, two]))
                ids = {names[i]: j for j, i in enumerate(left.tolist())}
                one, two = np.searchsorted(left, one), np.searchsorted(left, two)
                held[0] = np.where(key >> 31 > 0, (one + 1) << 31 | two, one)  # in the same order
        names = list(ids)
        terms = [f"{names[(x >> 31) - 1]} {names[x & (1 << 31) - 1]}" if x >> 31 else names[x] for x in held[0].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.array(np.append(held[1], total)), pa.array(np.append(held[2], rows)),
                                          pa.array(np.append(np.zeros(len(terms), np.int64), lost))], names=["term", "cf", "df", "lost"])
    return run


def frequent_terms(df: DataFrame, text_col: str, most: int, stop_words: Sequence[str] = STOP_WORDS, counters: int = COUNTERS) -> tuple[int, list[tuple[str, int, int]]]:
    """(number of rows, the ``most`` most frequent terms as (term, cf, df)), exactly, shuffling at most ``counters`` terms a task.

    A task's summary underrates a term by at most what it lost; summed over the
    tasks that is the slack.  With no slack the sums are exact.  Otherwise terms
    whose sum and slack reach the ``most``-th largest sum are counted again; a
    term in no summary has the slack at most, so none is missed while the slack
    is below that.  Where it is not, twice the counters are tried.
    """
    spark = df.sparkSession
    while True:
        parts = _token_lists(df, [], text_col).mapInArrow(_summaries(counters, stop_words), "term string, cf long, df long, lost long")
        sums = parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.sum("lost").alias("lost")).persist(StorageLevel.DISK_ONLY)
        top = sums.orderBy(F.col("term").isNull().desc(), F.desc("cf"), F.asc("term")).limit(most + 1).collect()
        head = [r for r in top if r["term"] is None]
        found = [(r["term"], r["cf"], r["df"]) for r in top if r["term"] is not None]
        rows, slack = (head[0]["df"], head[0]["lost"]) if head else (0, 0)
        least = found[-1][1] if len(found) == most else 0
        again = None
        if 0 < slack < least:
            again = [r["term"] for r in sums.where(F.col("term").isNotNull() & (F.col("cf") + slack >= least)).select("term").limit(CANDIDATES + 1).collect()]
        sums.unpersist()
        if slack == 0:
            return rows, found
        if again is not None:
            if len(again) <= CANDIDATES:
                exact = term_stats(df, text_col, stop_words, only=again).where("term IS NOT NULL")
                return rows, [(r["term"], r["cf"], r["df"]) for r in exact.orderBy(F.desc("cf"), "term").limit(most).collect()]
        counters *= 2


def _lists(row: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Values sorted by row as one list per row."""
    at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, v) for v in values]


def term_filter(vectors: DataFrame) -> np.ndarray:
    """Bits set at the hashes of all terms of a query side: 2 MB whatever the number of queries, made on the executors."""
    bits = vectors.select(F.explode("terms").alias("t")).select(F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(1 << FILTER_BITS)).alias("bit"))
    at = F.col("bit") + 1
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in bits.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect():
        out[(r["k"] - 1) * 4096:][:4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def _asked(names: list[str], bits: np.ndarray) -> np.ndarray:
    """Which terms may be a query's (every query term is; another one now and then)."""
    h = np.fromiter((zlib.crc32(t.encode()) for t in names), np.int64, len(names)) & ((1 << FILTER_BITS) - 1)
    return (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def term_vectors(df: DataFrame, id_col: str, text_col: str, weigh: Callable, stop_words: Sequence[str] = STOP_WORDS,
                 asked: np.ndarray | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """``(id, terms, weights)`` arrays, one row per input row; ``weigh(names) -> f(codes, tf, length, row) -> weights`` (0: left out).

    With ``asked`` (a ``term_filter``) only terms that a query may hold leave the batch, and rows without one do not.
    ``only``: the terms that have a weight, where these are few; without it the weights of a row's terms must not depend on each other.
    """
    bc = None if asked is None else df.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(list(stop_words), pa.string())
        # the words of a query's pair are terms of the query too
        keep = _words_of(only) if only is not None else None if bc is None else lambda words: _asked(words, bc.value)
        for rb in batches:
            row, code, tf, names, length = _terms(rb.column(1), stop, True, keep)
            w = weigh(names)(code, tf, length[row], row) if len(names) else np.zeros(0)
            on = w > 0
            if bc is not None and len(names):
                on &= _asked(names, bc.value)[code]
            terms = pa.array(names, pa.string()).take(pa.array(code[on]))
            out = pa.RecordBatch.from_arrays([rb.column(0), *_lists(row[on], rb.num_rows, terms, pa.array(w[on]))], names=[id_col, "terms", "weights"])
            yield out if bc is None else out.filter(pa.array(np.bincount(row[on], minlength=rb.num_rows) > 0))

    src = _token_lists(df, [id_col], text_col)
    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, terms array<string>, weights array<double>")


def _tfidf(idf: dict[str, float]) -> Callable:
    """tf x idf over a bounded vocabulary, unit length per row."""
    def weigh(names: list[str]):
        known = np.array([idf.get(t, 0.0) for t in names])

        def f(code, tf, length, row):
            raw = tf * known[code]
            norm = np.sqrt(np.bincount(row, weights=raw * raw)) if len(row) else np.zeros(0)
            return np.divide(raw, norm[row], out=np.zeros_like(raw), where=norm[row] > 0)
        return f
    return weigh


def sparse_search(queries: DataFrame, corpus: DataFrame, k: int, qid_col: str = "qid", id_col: str = "chunk_id", **kw) -> DataFrame:
    """``(qid, id, score, rank)``: top ``k`` by the sum of products over shared terms, score > 0 only.

    Both sides are term vectors (id, terms, weights).  Scores are made where a
    chunk's row is (see ``block_join``): no row per (query, chunk, term).
    """
    q = queries.select(F.col(qid_col).alias("_q"), F.col("terms").alias("_t"), F.col("weights").alias("_w"))
    c = corpus.select(F.col(id_col).alias("_i"), F.col("terms").alias("_t"), F.col("weights").alias("_w"))
    hits = block_join(q, c, lambda: _SparseTopK(k, "", False), id_col, "score", query_block=SPARSE_BLOCK, **kw)
    win = Window.partitionBy("qid").orderBy(F.round("score", RANK_DECIMALS).desc(), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k).withColumnRenamed("qid", qid_col)


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int, vocab: DataFrame, qid_col: str = "qid", qtext_col: str = "text",
                   id_col: str = "chunk_id", text_col: str = "content", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """D7 from texts: cosine of tf-idf vectors over ``vocab``, top ``k``, score > 0 only."""
    idf = {r["term"]: r["idf"] for r in vocab.select("term", "idf").collect()}  # at most max_features rows
    q = term_vectors(queries, qid_col, qtext_col, _tfidf(idf), stop_words, only=idf)
    values = vocab.agg(F.sum("df")).first()[0] or 0 if "df" in vocab.columns else None  # of all chunks
    return sparse_search(q, term_vectors(chunks, id_col, text_col, _tfidf(idf), stop_words, term_filter(q), idf), k, qid_col, id_col, sized=values)


def _weighted(df: DataFrame, id_col: str, text_col: str, idf: dict[str, float], stop_words: Sequence[str]) -> DataFrame:
    """``(id, term, tf, weight)``: tf x idf over the vocabulary (bounded), unit length per row; local to the row."""
    bc = df.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(list(stop_words), pa.string())
        known = bc.value
        keep = _words_of(known)
        for rb in batches:
            row, code, tf, names, _ = _terms(rb.column(1), stop, True, keep)
            w = np.array([known.get(t, 0.0) for t in names])[code] if len(names) else np.zeros(0)
            on = w > 0
            row, code, tf, raw = row[on], code[on], tf[on], tf[on] * w[on]
            norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=rb.num_rows))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(code)), pa.array(tf), pa.array(raw / norm[row])],
                names=[id_col, "term", "tf", "weight"])

    src = _token_lists(df, [id_col], text_col)
    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, term string, tf long, weight double")


def build_tfidf(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content",
                max_features: int = MAX_FEATURES, stop_words: Sequence[str] = STOP_WORDS):
    """Returns ``(vocab, postings)``.

    idf is the smoothed form ``ln((1+n)/(1+df)) + 1`` with ``n`` the number of
    chunks; weights are ``tf * idf`` scaled to unit length per chunk over the
    kept vocabulary.  One pass finds the vocabulary, of which at most
    ``max_features`` rows come to the driver; the postings are a second pass.
    """
    spark = chunks.sparkSession
    n, top = frequent_terms(chunks, text_col, max_features, stop_words)
    rows = [(t, cf, df, math.log((1.0 + n) / (1.0 + df)) + 1.0) for t, cf, df in top]
    vocab = spark.createDataFrame(rows, "term string, cf long, df long, idf double")
    return vocab, _weighted(chunks, id_col, text_col, {r[0]: r[3] for r in rows}, stop_words)


def save_index(vocab: DataFrame, postings: DataFrame, path: str) -> None:
    """Store the index under ``path`` (built once, queried many times)."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    postings.write.mode("overwrite").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/postings")


def query_weights(queries: DataFrame, vocab: DataFrame, qid_col: str = "qid",
                  text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(qid, term, qweight)``: the query's tf-idf over the index vocabulary, unit length."""
    idf = {r["term"]: r["idf"] for r in vocab.select("term", "idf").collect()}  # at most max_features rows
    return _weighted(queries, qid_col, text_col, idf, stop_words).select(qid_col, "term", F.col("weight").alias("qweight"))


def _runs(postings: DataFrame, asked: np.ndarray, id_col: str) -> DataFrame:
    """``(_i, _t, _w)``: neighbouring rows of a chunk as one row of term and weight lists, with the terms that a query may hold only."""
    bc = postings.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            enc = rb.column(1).dictionary_encode()
            on = pa.array(np.flatnonzero(_asked(enc.dictionary.to_pylist(), bc.value)[np.asarray(enc.indices)]) if rb.num_rows else [], pa.int64())
            ids, terms, weights = (rb.column(i).take(on) for i in range(3))
            new = np.append(True, np.asarray(pc.not_equal(ids[1:], ids[:-1]))) if len(ids) else np.zeros(0, bool)
            row = np.cumsum(new) - 1
            n = int(new.sum())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(new)), *_lists(row, n, terms, weights)], names=["_i", "_t", "_w"])

    src = postings.select(F.col(id_col).alias("_i"), "term", F.col("weight").cast("double"))
    ship_package(postings.sparkSession)
    return src.where("_i IS NOT NULL AND term IS NOT NULL").mapInArrow(run, f"_i {src.schema['_i'].dataType.simpleString()}, _t array<string>, _w array<double>")


def lexical_search(qweights: DataFrame, postings: DataFrame, k: int, qid_col: str = "qid",
                   id_col: str = "chunk_id") -> DataFrame:
    """``(qid, id, score, rank)`` — cosine of tf-idf vectors, top ``k``, score > 0 only.

    ``qweights`` comes from ``query_weights``.  Rows of a chunk that lie next to
    each other are one row from the scan on; a cell puts the others together, so
    there is no row per (query, chunk, term).
    """
    own = qweights.where("term IS NOT NULL").groupBy(qid_col, "term").agg(F.sum("qweight").alias("qweight"))
    q = own.groupBy(qid_col).agg(F.collect_list(F.struct("term", "qweight")).alias("_l"))
    q = q.select(F.col(qid_col).alias("_q"), F.col("_l.term").alias("_t"), F.col("_l.qweight").alias("_w"))
    c = _runs(postings, term_filter(q.withColumnRenamed("_t", "terms")), id_col)
    hits = block_join(q, c, lambda: _SparseTopK(k, "", False, True), id_col, "score", query_block=SPARSE_BLOCK).withColumnRenamed("qid", qid_col)
    bare = postings.where(F.col(id_col).isNull()).join(qweights, "term")  # rows without id count as one chunk
    bare = bare.groupBy(qid_col, id_col).agg(F.sum(F.col("qweight") * F.col("weight")).alias("score")).filter(F.col("score") > 0)
    win = Window.partitionBy(qid_col).orderBy(F.round("score", RANK_DECIMALS).desc(), F.col(id_col))
    return hits.unionByName(bare).withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k)


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, qid_col: str = "qid",
                qtext_col: str = "text", id_col: str = "chunk_id", text_col: str = "content",
                k1: float = 1.2, b: float = 0.75,
                stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Okapi BM25 over the same analyzer (uni+bigrams), every term kept.

    ``idf = ln(1 + (n - df + 0.5) / (df + 0.5))``; score =
    ``sum over distinct query terms of idf * tf (k1+1) / (tf + k1 (1 - b + b len/avglen))``
    with ``len`` the chunk's term count.  One pass gives document frequencies,
    ``n`` and the average length; a second scores the postings.
    """
    stats = term_stats(chunks, text_col, stop_words)
    total = stats.where("term IS NULL").select("cf", "df").first()  # two numbers
    n, avg_len = (total["df"], total["cf"] / total["df"]) if total and total["df"] else (0, 1.0)
    qt = term_counts(queries, qid_col, qtext_col, stop_words).select(qid_col, "term")
    df = F.col("df")
    q = qt.join(stats.where("term IS NOT NULL").select("term", "df"), "term")
    q = q.groupBy(qid_col).agg(F.collect_list(F.struct("term", F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5))).alias("idf"))).alias("_l"))
    q = q.select(qid_col, F.col("_l.term").alias("terms"), F.col("_l.idf").alias("weights"))

    def weigh(names: list[str]):
        return lambda code, tf, length, row: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / avg_len))

    return sparse_search(q, term_vectors(chunks, id_col, text_col, weigh, stop_words, term_filter(q)), k, qid_col, id_col)
