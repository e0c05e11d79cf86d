"""Operator 12: phrase collocations, counted in HAT-tries whose subtrees are spilled as sorted runs.

Texts are split at punctuation and line ends into pieces and those into words;
a word's id is the 64-bit hash of its lower-cased bytes.  Phrases are counted
in three passes over the texts: words, pairs of words that are frequent, and
phrases of three and four words all of whose pairs are frequent (a phrase is
never more frequent than a part of it, so no candidate is lost).  "Frequent"
is read from a bit filter of fixed size; a false positive costs only work.

1. A task counts its phrases in a trie with word ids as edges.  Its leaves are
   hash containers for a range of words, filled a slice at a time; one that grows over
   ``BURST`` entries is cut into narrower ranges, at last into a trie node of one word.
   Over ``LIMIT`` entries the largest subtrees leave the task as sorted runs.
2. A run is cut by prefix: all of a phrase but its last word, and the leading
   bits of that word's id, so that not even the phrases that begin with one
   frequent word or pair meet in one task.  Runs of a prefix partition are merged and
   counts under ``min_count`` dropped.
3. Scores, parts and longer phrases are joins of the frequent phrases with themselves.

Defined results: null text is empty, null lang is ``und``; empty and very long
texts, repeated rows, null ids and extra columns need no special care (ids are
not read); ties are broken by phrase in UTF-8 byte order; a table without
candidates gives an empty result.
"""

from __future__ import annotations

import hashlib
import operator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import textkit as tk
from .flow import Stage, null_safe
from .near_sets import _complete

MIN_COUNT, TOP, LONGEST, INSIDE = 30, 2000, 4, 80
SLICE = 2 << 20
BURST, LIMIT = 20_000, 300_000  # entries of a container, of a task's tries
FAN = 8                         # narrower containers made of one
MERGE = 100_000                 # entries of runs that are merged at a time
BITS = 26                       # log2 of the bits of a filter (8 MB, whatever the input)

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\v\f\r")] = True
SEP = BREAK.copy()
SEP[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lang_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def _fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its front (at first the language's) and its last word."""
    return tk.mix(h * _STEP + word)


class HatTrie:
    """Counts of phrases of ``k`` word ids: by ranges of first words hash containers {phrase: count}.

    A container with over ``BURST`` entries is cut into ``FAN`` narrower ranges
    or so; one of a single first word becomes a trie of the rest.
    """

    def __init__(self, k: int):
        self.k, self.size = k, 0
        self.start, self.child = [0], {0: {}}  # child[w]: phrases whose first word is w or more, but less than the next start

    def __len__(self) -> int:
        return self.size

    def _range(self, i: int) -> int:
        return (self.start[i + 1] if i + 1 < len(self.start) else 1 << 64) - self.start[i]

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words[:, 0])
        words, counts = np.ascontiguousarray(words[order]), counts[order]
        at = [*np.searchsorted(words[:, 0], np.array(self.start, np.uint64)).tolist(), len(counts)]
        keys, numbers = words.view(f"V{8 * self.k}").ravel().tolist(), counts.tolist()
        for i in range(len(self.start) - 1, -1, -1):  # cutting a container moves later ones only
            a, b, node = at[i], at[i + 1], self.child[self.start[i]]
            if a == b:
                continue
            before = len(node)
            if isinstance(node, HatTrie):
                node.add(words[a:b, 1:], counts[a:b])
            else:
                node.update(zip(keys[a:b], map(operator.add, map(node.get, keys[a:b], repeat(0)), numbers[a:b])))
            self.size += len(node) - before
            if isinstance(node, dict) and len(node) > BURST:
                self._burst(i)

    def _burst(self, i: int) -> None:
        lo = self.start[i]
        if self._range(i) == 1 and self.k == 2:
            return
        words, counts = self._entries(self.child[lo], self.k)
        if self._range(i) == 1:
            self.child[lo] = HatTrie(self.k - 1)
            self.child[lo].add(words[:, 1:], counts)
            return
        order = np.argsort(words[:, 0])
        words, counts = words[order], counts[order]
        first, n = np.unique(words[:, 0], return_counts=True)
        own = first[n > len(counts) // FAN].tolist()  # words with a range of their own
        cuts = {lo, *words[len(counts) * np.arange(1, FAN) // FAN, 0].tolist(), *own, *(w + 1 for w in own)} - {lo + self._range(i)}
        start = sorted(cuts)
        at = [*np.searchsorted(words[:, 0], np.array(start, np.uint64)).tolist(), len(counts)]
        keys, numbers = words.view(f"V{8 * self.k}").ravel().tolist(), counts.tolist()
        self.start[i:i + 1] = start
        self.child.update((w, dict(zip(keys[a:b], numbers[a:b]))) for w, a, b in zip(start, at, at[1:]))
        for j in range(i + len(start) - 1, i - 1, -1):
            if len(self.child[self.start[j]]) > BURST:
                self._burst(j)

    @staticmethod
    def _entries(container: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.frombuffer(b"".join(container), np.uint64).reshape(len(container), k),
                np.fromiter(container.values(), np.int64, len(container)))

    def entries(self, children: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, counts) below the named children, or all."""
        words, counts = [np.zeros((0, self.k), np.uint64)], [np.zeros(0, np.int64)]
        for w in self.child if children is None else children:
            node = self.child[w]
            if isinstance(node, HatTrie):
                rest, n = node.entries()
                own = np.concatenate([np.full((len(rest), 1), w, np.uint64), rest], axis=1)
            else:
                own, n = self._entries(node, self.k)
            words.append(own)
            counts.append(n)
        return np.concatenate(words), np.concatenate(counts)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees, largest first, until ``keep`` entries at most are left."""
        out, left = [], self.size
        for n, w in sorted(((len(c), w) for w, c in self.child.items()), reverse=True):
            if left <= keep:
                break
            out.append(w)
            left -= n
        found = self.entries(out)
        for w in out:
            self.child[w] = {}
        self.size = left
        return found


class _Words:
    """Words of a slice of texts: ids, spans, pieces and the hash of each text's language."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray):
        self.low = tk.LOWER[data]
        self.start, self.end, self.doc = tk.words(self.low, off, SEP)
        self.id = tk.span_hash(self.low, self.start, self.end)
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[self.low], out=ends[1:])
        self.piece = ends[self.start] + self.doc  # never falls, and rises between two pieces
        self.lang = langs[self.doc]

    def folded(self, k: int) -> np.ndarray:
        """Hash of the phrase of k words that begins at each word (whether in one piece or not)."""
        n = max(len(self.id) - k + 1, 0)
        h = self.lang[:n]
        for j in range(k):
            h = _fold(h, self.id[j:j + n])
        return h

    def whole(self, k: int) -> np.ndarray:
        return self.piece[k - 1:] == self.piece[:max(len(self.id) - k + 1, 0)]


def _slices(batch):
    """(words, language codes) of slices of a batch (text, lang)."""
    lang = batch.column(1).dictionary_encode()
    names = lang.dictionary.to_pylist()
    code = np.asarray(lang.indices)
    hashes = np.array([_lang_hash(x) for x in names], np.uint64)
    data, off = tk.text_bytes(batch.column(0))
    for i, j in tk.slices(off, SLICE):
        yield _Words(*tk.cut(data, off, i, j), hashes[code[i:j]]), code[i:j], names


def _count_words(batches):
    """Distinct words of each slice: (lang, word, n, bit, text)."""
    for batch in batches:
        for words, code, names in _slices(batch):
            h = words.folded(1)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            text = [words.low[a:b].tobytes() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
            lang = pa.array(names, pa.string()).take(pa.array(code[words.doc[at]]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(tk.signed(words.id[at])), pa.array(n), pa.array((u >> np.uint64(64 - BITS)).astype(np.int64)),
                                              pa.array(text, pa.binary()).cast(pa.string())], ["lang", "word", "n", "bit", "text"])


def _filter(bits: DataFrame) -> np.ndarray:
    """Bits set at the values of column ``bit``: a fixed number of bytes, aggregated on the executors."""
    at = F.col("bit") + 1
    rows = bits.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        out[(r["chunk"] - 1) * 4096:][:4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _cut(lang: str, k: int, words: np.ndarray, counts: np.ndarray, buckets: int):
    """A sorted run by prefix partition: (bucket, lang, k, words, counts)."""
    front = np.full(len(words), _lang_hash(lang), np.uint64)
    for j in range(k - 1):
        front = _fold(front, words[:, j])
    bucket = (_fold(front, words[:, -1] >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((*words.T[::-1], bucket))
    words, counts, bucket = np.ascontiguousarray(words[order]), counts[order], bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
    for a, b in zip(starts, [*starts[1:], len(words)]):
        yield int(bucket[a]), lang, k, words[a:b].tobytes(), counts[a:b].tobytes()


def _runs(cuts):
    """One row per prefix partition with its cuts of all runs that leave the task at a time."""
    cuts = sorted(cuts, key=lambda c: c[0])
    starts = [i for i in range(len(cuts)) if i == 0 or cuts[i][0] != cuts[i - 1][0]]
    at = np.array([*starts, len(cuts)])
    columns = list(zip(*cuts))
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c, t)) for c, t in zip(columns[1:], (pa.string(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([columns[0][i] for i in starts], pa.int64()), *lists], ["bucket", "lang", "k", "words", "counts"])


def _count_phrases(bits, base: int, lengths: tuple[int, ...], buckets: int):
    """Runs of the phrases of the given lengths all of whose parts of ``base`` words are in the filter."""
    def run(batches):
        tries: dict[tuple[str, int], HatTrie] = {}

        def spill(keep: int):
            cuts = [c for (lang, k), trie in tries.items() if len(trie) > keep for c in _cut(lang, k, *trie.spill(keep), buckets)]
            if cuts:
                yield _runs(cuts)

        for batch in batches:
            for words, code, names in _slices(batch):
                ok = words.whole(base) & _has(bits.value, words.folded(base))
                for k in lengths:
                    n = max(len(words.id) - k + 1, 0)
                    on = words.whole(k)
                    for j in range(k - base + 1):
                        on &= ok[j:j + n]
                    at = np.flatnonzero(on)
                    _, first, count = np.unique(words.folded(k)[at], return_index=True, return_counts=True)
                    at = at[first]
                    phrase, lang = np.stack([words.id[at + j] for j in range(k)], axis=1), code[words.doc[at]]
                    for c in np.unique(lang).tolist():
                        tries.setdefault((names[c], k), HatTrie(k)).add(phrase[lang == c], count[lang == c])
                if sum(map(len, tries.values())) > LIMIT:
                    yield from spill(LIMIT // (2 * len(tries)))
        yield from spill(0)
    return run


def _ranges(runs: list[tuple[np.ndarray, np.ndarray]]):
    """Sorted runs side by side, by ranges of the first word of ``MERGE`` entries or so."""
    n = -(-sum(len(c) for _, c in runs) // MERGE)
    edges = [np.uint64((i << 64) // n) for i in range(n)]
    at = [[*np.searchsorted(w[:, 0], edges).tolist(), len(c)] for w, c in runs]
    for i in range(n):
        yield tuple(np.concatenate([r[p][at[j][i]:at[j][i + 1]] for j, r in enumerate(runs)]) for p in (0, 1))


def _merged(min_count: int):
    """Runs of a prefix partition -> the phrases with ``min_count`` occurrences or more."""
    def run(batches):
        for table in _complete(batches, ["bucket"]):
            parts: dict[tuple[str, int], list] = {}
            for lang, k, w, n in zip(*(table[c].combine_chunks().flatten().to_pylist() for c in ("lang", "k", "words", "counts"))):
                parts.setdefault((lang, k), []).append((np.frombuffer(w, np.uint64).reshape(-1, k), np.frombuffer(n, np.int64)))
            for lang, k, words, counts in ((*of, *r) for of, runs in parts.items() for r in _ranges(runs)):
                order = np.lexsort(words.T[::-1])
                words, counts = words[order], counts[order]
                if len(words) == 0:
                    continue
                starts = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
                f = np.add.reduceat(counts, starts)
                words, f = words[starts[f >= min_count]], f[f >= min_count]
                if len(f):
                    h = np.full(len(f), _lang_hash(lang), np.uint64)
                    for j in range(k):
                        h = _fold(h, words[:, j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(f)), tk.list_array(tk.signed(np.ascontiguousarray(words).ravel()), np.arange(0, len(f) * k + 1, k)), pa.array(f),
                         pa.array((h >> np.uint64(64 - BITS)).astype(np.int64))], ["lang", "ids", "f", "bit"])
    return run


def frequent_phrases(st: Stage, docs: DataFrame, min_count: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f, bit, text) of all words and (lang, ids, f) of the phrases of 1 to 4 words with ``min_count`` occurrences."""
    spark: SparkSession = docs.sparkSession
    src = docs.select(null_safe(F.col(text_col)).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = src.mapInArrow(_count_words, "lang string, word long, n long, bit long, text string")
    words = st.keep(counted.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.min("bit").alias("bit"), F.min("text").alias("text")), "words")

    def phrases(shorter: DataFrame, base: int, lengths: tuple[int, ...]) -> DataFrame:
        bits = spark.sparkContext.broadcast(_filter(shorter.select("bit")))
        runs = src.mapInArrow(_count_phrases(bits, base, lengths, buckets), "bucket long, lang array<string>, k array<int>, words array<binary>, counts array<binary>")
        merged = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged(min_count), "lang string, ids array<long>, f long, bit long")
        out = st.keep(merged, f"phrases{base}")
        bits.destroy()
        return out

    pairs = phrases(words.where(F.col("f") >= min_count), 1, (2,))
    longer = phrases(pairs, 2, tuple(range(3, LONGEST + 1)))
    single = words.where(F.col("f") >= min_count).select("lang", F.array("word").alias("ids"), "f")
    return words, single.unionByName(pairs.select("lang", "ids", "f")).unionByName(longer.select("lang", "ids", "f"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 4 words.

    A phrase that lies in a longer one with at least ``inside`` percent of its
    occurrences is left out.
    """
    st = Stage(docs.sparkSession, "phrases")
    words, phrases = frequent_phrases(st, docs, min_count, text_col, lang_col)
    size = F.size("ids")
    found = phrases.where(size > 1).withColumnRenamed("f", "a")
    part = phrases.withColumnsRenamed({"ids": "part", "f": "pf"})
    big = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits

    cuts = found.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = (cuts.withColumn("part", F.slice("ids", F.lit(1), F.col("k"))).join(part, ["lang", "part"]).withColumnRenamed("pf", "l")
            .withColumn("part", F.slice("ids", F.col("k") + 1, size - F.col("k"))).join(part, ["lang", "part"]).withColumnRenamed("pf", "r")
            .withColumns({"top": F.lit(2_000_000).cast("decimal(10,0)") * big("a"), "sum": big("l") + big("r")}).withColumn("score", F.expr("top div sum")))
    scored = cuts.groupBy("lang", "ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("ids", s, m))))
    longest = (found.where(size > 2).select("lang", F.explode(inner).alias("ids"), "a")
               .groupBy("lang", "ids").agg(F.max("a").alias("longer")))
    own = scored.join(longest, ["lang", "ids"], "left").where(F.col("longer").isNull() | (100 * big("longer") < inside * big("a")))

    by = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    best = own.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place")
    text = (best.select("lang", "ids", F.posexplode("ids").alias("at", "word")).join(words.select("lang", "word", "text"), ["lang", "word"])
            .groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("phrase")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = (best.join(text, ["lang", "ids"]).join(totals, "lang")
              .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top))
    out = st.hold(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                                F.col("cut.score").cast("long").alias("score")))
    st.drop(*list(st.paths))
    return out


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS doc FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
freq AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
cuts AS (SELECT c.*, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:k], ' ') AS y
         FROM cand c, (SELECT unnest([1, 2, 3]) AS i) WHERE i < k),
scored AS (SELECT u.lang, u.k, u.phrase, u.a, u.i, p.f AS l, q.f AS r, ((2000000::HUGEINT * u.a) // (p.f + q.f))::BIGINT AS score
           FROM cuts u JOIN freq p ON p.lang = u.lang AND p.phrase = u.x AND p.k = u.i JOIN freq q ON q.lang = u.lang AND q.phrase = u.y AND q.k = u.k - u.i),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, i) = 1),
inner_ AS (SELECT lang, m AS k, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
           FROM cand, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
own AS (SELECT z.* FROM lowest z LEFT JOIN inner_ i ON i.lang = z.lang AND i.k = z.k AND i.phrase = z.phrase
        WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * z.a::HUGEINT)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM own o JOIN totals t ON t.lang = o.lang QUALIFY rank <= 2000
"""
