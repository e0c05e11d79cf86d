"""Operator 7: n-gram Jaccard join by set-relation skipping.

Exact links between documents whose shingle sets have Jaccard similarity of
``PERCENT`` or more, reported as connected components.

* Equal sets are one class; only classes go on.
* Index lists: a class is listed under its first ``n - ceil(t n) + 1`` shingles
  (prefix filter).  Shingles found often (``hot_shingles``) come last in the
  order, so common passages seldom open a list; any fixed order is exact.
* Block-skip by position: a list is sorted by set size; a probe meets the block
  of sizes within the threshold only, and skips entries whose position leaves
  too few shingles, that shared an earlier list with it, or whose parity bitmap
  (a lower bound of the symmetric difference) rules a link out.
* Answers from highly similar sets: in a first round every class is verified
  against its most similar candidate and the list's centre; classes so linked
  share one answer (component).  The second round skips all pairs with equal
  answers and verifies every other candidate.

Lists longer than ``LIST_BLOCK`` are split into blocks and block pairs, so no
task holds a whole hot list.

Defined results: null or wordless text has n_shingles 0 and its own id as
component; rows with equal ids and different texts are documents of their own;
rows without id link like others; a component's id is the smallest id in it
(null if none has one); an empty table gives an empty result; extra columns are
ignored; ids keep their type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .flow import Stage, components

K, PERCENT = 4, 85
BITS = 1024
LIST_BLOCK = 8192
PAIRS = 400_000  # pairs of a long list compared at a time
HOT_IN_SLICE, HOT_LEAST, HOT_MOST = 4, 100, 100_000


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every document, offsets).  Fewer than k words: the sequence as one."""
    n = len(off) - 1
    start, end, doc = tk.words(data, off, tk.SPACE_SEP)
    h = tk.span_hash(data, start, end, lower=True)
    ix, g = tk.grams(h, doc, k)
    first = tk.first_of(doc[ix], n)
    count = np.bincount(doc, minlength=n)
    sets = [np.unique(g[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            at, s = tk.grams(h, doc, size)
            own = s[np.searchsorted(doc[at], short)] ^ np.uint64(size)
            for d, v in zip(short.tolist(), own):
                sets[d] = np.array([v], np.uint64)
    sizes = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=sizes[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def _sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def set_keys(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit key of each set, as two signed longs."""
    n = np.diff(at).astype(np.uint64)
    return tk.signed(tk.mix(_sum_by(tk.mix(u), at) + n)), tk.signed(tk.mix(_sum_by(tk.mix(~u), at) ^ n))


def width(n: np.ndarray) -> np.ndarray:
    """Bits of a set's own bitmap: the power of two from 2 n on, BITS at least."""
    return np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64))


def bitmaps(u: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: popcount(a ^ b) never exceeds the symmetric difference.  Halves fold by xor."""
    w = width(np.diff(at))
    start = np.concatenate([[0], np.cumsum(w)])
    doc = np.repeat(np.arange(len(w)), np.diff(at))
    bit = (u & (w[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(start[doc] + bit, minlength=int(start[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[i:j].tobytes() for i, j in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist())]


def fold(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bits."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size // 8), axis=0)


def _classes(k: int):
    """doc rows (kind 0: id, text key, set keys, size, bitmap) and shingles seen in several documents of a slice (kind 1)."""
    names = ["kind", "doc_id", "text_key", "k1", "k2", "n", "bits"]

    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(1))
            for i, j in tk.slices(off, 1 << 20):
                u, at = shingle_sets(*tk.cut(data, off, i, j), k)
                k1, k2 = set_keys(u, at)
                n = np.diff(at)
                maps = bitmaps(u, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(k1), pa.array(k2), pa.array(n),
                     pa.array(maps, pa.binary())], names)
                _, rep = np.unique(np.stack([k1, k2]), axis=1, return_index=True)
                keep = np.zeros(j - i, bool)
                keep[rep] = True
                s = np.sort(u[np.repeat(keep, n)])
                v, c = np.unique(s, return_counts=True)
                hot = np.flatnonzero(c >= HOT_IN_SLICE)
                z = pa.nulls(len(hot))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(hot), np.int32)), z.cast(batch.column(0).type), z.cast(pa.int64()), pa.array(tk.signed(v[hot])), z.cast(pa.int64()),
                     pa.array(c[hot]), z.cast(pa.binary())], names)
    return run


def _prefixes(k: int, percent: int, hot: np.ndarray):
    """(shingle, k1, place) of every prefix entry; hot shingles come last in the order."""
    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(0))
            for i, j in tk.slices(off, 1 << 20):
                u, at = shingle_sets(*tk.cut(data, off, i, j), k)
                k1, _ = set_keys(u, at)
                _, once = np.unique(k1, return_index=True)  # copies within the slice are listed once
                is_hot = np.zeros(len(u), bool)
                if len(hot) and len(u):
                    is_hot = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
                out: tuple[list, list, list] = ([], [], [])
                for d in once.tolist():
                    a, b = at[d], at[d + 1]
                    n = b - a
                    if n == 0:
                        continue
                    p = n - -(-percent * n // 100) + 1
                    own, warm = u[a:b], is_hot[a:b]
                    out[0].append(np.concatenate([own[~warm], own[warm]])[:p] if warm.any() else own[:p])
                    out[1].append(np.full(p, k1[d]))
                    out[2].append(np.arange(p, dtype=np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(tk.signed(np.concatenate(out[0]))), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]))], ["shingle", "k1", "place"])
    return run


_ENTRY = "shingle long, blocks int, block int, id long, n long, place int, before1 long, before2 long, bits binary, answer long"
ENTRY_ROWS = 20_000  # index entries per output batch


def _entries(batches):
    """(id, n, bits, [(place, shingle, blocks)], answer) -> index list entries, each with the two entries before it."""
    names = [c.split()[0] for c in _ENTRY.split(", ")]
    for batch in batches:
        ids, n, bits, lists, answer = batch.columns
        size = np.asarray(lists.value_lengths())
        flat = lists.flatten()
        place, shingle, blocks = (np.asarray(flat.field(c)) for c in ("place", "shingle", "blocks"))
        row = np.repeat(np.arange(batch.num_rows), size)
        by = np.lexsort((shingle, place, row))
        row, place, shingle, blocks = row[by], place[by], shingle[by], blocks[by]
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        short = pa.array([fold(b, BITS).tobytes() for b in bits.to_pylist()], pa.binary())
        own = np.asarray(ids)
        for lo in range(0, len(row), ENTRY_ROWS):
            k = np.arange(lo, min(lo + ENTRY_ROWS, len(row)))
            r = pa.array(row[k])
            back = [pa.array(shingle[np.maximum(k - d, 0)], mask=nth[k] < d) for d in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle[k]), pa.array(blocks[k]), pa.array((own[row[k]] % blocks[k]).astype(np.int32)), ids.take(r), n.take(r), pa.array(place[k]),
                 *back, short.take(r), answer.take(r)], names)


def _complete(batches, keys: list[str]):
    """Batches regrouped (rows sorted by ``keys``) so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        cols = [np.asarray(table[k].combine_chunks()) for k in keys]
        last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


class _Lists:
    """Arrays of whole index lists; ``survivors`` are the pairs that no filter rules out."""

    def __init__(self, table: pa.Table, percent: int):
        col = lambda c: table[c].combine_chunks()
        self.percent = percent
        key = np.stack([np.asarray(col(c)).astype(np.int64) for c in ("shingle", "lo", "hi")])
        self.group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        self.cross = key[1] != key[2]
        self.block, self.id, self.n, self.place, self.answer = (np.asarray(col(c)).astype(np.int64) for c in ("block", "id", "n", "place", "answer"))
        size = table.num_rows
        self.b1, self.b2 = (np.where(np.asarray(col(c).is_valid()), np.asarray(col(c).fill_null(0)), 2 * np.arange(size) + d)
                            for c, d in (("before1", 1), ("before2", 2)))  # without an entry before: a value of its own
        self.bits = np.frombuffer(b"".join(col("bits").to_pylist()), np.uint64).reshape(size, BITS // 64)

    def _filter(self, i: np.ndarray, j: np.ndarray, other_answer: bool):
        """Pairs (i before j in the list, so n[i] <= n[j])."""
        t, n = self.percent, self.n
        total = n[i] + n[j]
        rest = 1 + np.minimum(n[i] - self.place[i], n[j] - self.place[j]) - 1
        ok = (100 * n[i] >= t * n[j]) & ((100 + t) * rest >= t * total) & (self.id[i] != self.id[j])
        ok &= ~self.cross[i] | (self.block[i] != self.block[j])
        if other_answer:
            ok &= self.answer[i] != self.answer[j]
        i, j = i[ok], j[ok]
        ok = (self.b1[i] != self.b1[j]) & (self.b1[i] != self.b2[j]) & (self.b2[i] != self.b1[j]) & (self.b2[i] != self.b2[j])
        i, j = i[ok], j[ok]
        gap = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64)
        ok = (100 + t) * gap <= (100 - t) * (n[i] + n[j])
        return i[ok], j[ok], gap[ok]

    def survivors(self, other_answer: bool):
        size = np.bincount(self.group)
        first = np.concatenate([[0], np.cumsum(size)])
        out = []
        small = size[self.group] <= 64
        for d in range(1, 64):
            i = np.flatnonzero((self.group[d:] == self.group[:-d]) & small[d:])
            if len(i) == 0:
                break
            out.append(self._filter(i, i + d, other_answer))
        for g in np.flatnonzero(size > 64).tolist():
            a, b = int(first[g]), int(first[g + 1])
            n = self.n[a:b]
            stop = a + np.searchsorted(n, n * 100 // self.percent, "right")  # the block of sizes within the threshold
            step = max(1, PAIRS // (b - a))
            for s in range(a, b, step):
                e = min(s + step, b)
                width = stop[s - a:e - a] - np.arange(s, e) - 1
                width = np.maximum(width, 0)
                i = np.repeat(np.arange(s, e), width)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
                if len(i):
                    out.append(self._filter(i, j, other_answer))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out))


def _first_round(percent: int):
    """For each entry: its most similar candidate (kind 0) and its list's centre (kind 1), if they pass the filters."""
    def run(batches):
        for table in _complete(batches, ["shingle", "lo", "hi"]):
            lists = _Lists(table, percent)
            i, j, gap = lists.survivors(False)
            if len(i) == 0:
                continue
            m = len(lists.n)
            best = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(best, i, (gap << 32) | j)
            np.minimum.at(best, j, (gap << 32) | i)
            degree = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
            by = np.lexsort((lists.id, -degree, lists.group))
            centre = by[np.searchsorted(lists.group[by], np.arange(lists.group[-1] + 1))][lists.group]
            has = np.flatnonzero(degree)
            a, b, kind, w = [lists.id[has]], [lists.id[best[has] & 0xFFFFFFFF]], [np.zeros(len(has), np.int32)], [best[has] >> 32]
            for x, y in ((i, j), (j, i)):
                star = np.flatnonzero(centre[x] == y)
                a.append(lists.id[x[star]])
                b.append(lists.id[y[star]])
                kind.append(np.ones(len(star), np.int32))
                w.append(-degree[y[star]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, kind, w)], ["a", "b", "kind", "w"])
    return run


def _second_round(percent: int):
    """Distinct candidate pairs with different answers."""
    def run(batches):
        for table in _complete(batches, ["shingle", "lo", "hi"]):
            lists = _Lists(table, percent)
            i, j, _ = lists.survivors(True)
            if len(i):
                a, b = lists.id[i], lists.id[j]
                p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0].copy()), pa.array(p[1].copy())], ["a", "b"])
    return run


def _likely(percent: int):
    """Pairs whose own bitmaps (about two bits a shingle) do not rule a link out."""
    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for r in range(len(a)):
                size = 8 * min(len(x[r]), len(y[r]))
                gap = int(np.bitwise_count(fold(x[r], size) ^ fold(y[r], size)).sum())
                if (100 + percent) * gap <= (100 - percent) * (n[r] + m[r]):
                    keep.append(r)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])
    return run


def _verified(k: int, percent: int):
    """Pairs with both texts -> pairs whose whole sets are similar enough."""
    def run(batches):
        for batch in batches:
            found = []
            sides = [tk.text_bytes(batch.column(c)) for c in (2, 5)]
            keys = [np.stack([np.asarray(batch.column(c)), np.asarray(batch.column(c + 1))]) for c in (3, 6)]
            for lo in range(0, batch.num_rows, 64):
                hi = min(lo + 64, batch.num_rows)
                parts = [shingle_sets(*tk.cut(*side, lo, hi), k) for side in sides]
                same = np.logical_and.reduce([(np.stack(set_keys(*p)) == key[:, lo:hi]).all(axis=0) for p, key in zip(parts, keys)])
                (u, at), (v, to) = parts
                for r in np.flatnonzero(same).tolist():
                    x, y = u[at[r]:at[r + 1]], v[to[r]:to[r + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append(lo + r)
            yield batch.take(pa.array(found, pa.int64())).select(["a", "b"])
    return run


def _linked(st: Stage, tag: str, pairs: DataFrame, src: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose whole sets are similar enough.  Only texts of likely pairs are moved."""
    own = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    likely = (pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
              .mapInArrow(_likely(percent), "a long, b long"))
    likely = st.keep(likely, f"{tag}-likely")
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct().join(classes.select("id", "k1", "k2", "rep"), "id")
    ids = ids.select("id", "k1", "k2", F.col("rep.doc_id").alias("doc"), F.col("rep.text_key").alias("text_key"))
    own = src.join(ids, [src["text_key"] == ids["text_key"], src["doc_id"].eqNullSafe(ids["doc"])])
    texts = st.keep(own.select("id", "text", "k1", "k2").dropDuplicates(["id"]), f"{tag}-texts")  # a repeated row lends its text once
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"), F.col("k1").alias(f"p{c}"), F.col("k2").alias(f"q{c}"))
    both = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "pa", "qa", "tb", "pb", "qb")
    out = st.keep(both.mapInArrow(_verified(k, percent), "a long, b long"), tag)
    st.drop(f"{tag}-likely", f"{tag}-texts")
    return out


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) for every document."""
    spark = docs.sparkSession
    st = Stage(spark, "nearsets")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    kinds = st.keep(src.mapInArrow(_classes(k), f"kind int, doc_id {kind}, text_key long, k1 long, k2 long, n long, bits binary"), "kinds")
    rows = kinds.where("kind = 0").select("doc_id", "text_key", "k1", "k2", "n", "bits")
    top = kinds.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("c")).where(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "k1").limit(HOT_MOST).select("k1").toPandas()
    hot = np.sort(top["k1"].to_numpy(np.int64, copy=True).view(np.uint64)) if len(top) else np.zeros(0, np.uint64)
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    classes = (rows.where("n > 0").groupBy("k1", "k2")
               .agg(F.min("doc_id").alias("first_id"), rep.alias("rep"), F.first("n").alias("n"), F.max("bits").alias("bits"), F.count(F.lit(1)).alias("copies")))
    classes = st.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written with its numbers
    prefix = st.keep(src.select("text").mapInArrow(_prefixes(k, percent, hot), "shingle long, k1 long, place int"), "prefix")
    shared = prefix.groupBy("shingle").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo != hi").select(
        "shingle", F.ceil(F.col("c") / LIST_BLOCK).cast("int").alias("blocks"))
    shared = st.keep(shared, "shared")  # as a table of its own, so that AQE can split the other side of the join
    listed = st.keep(prefix.join(shared, "shingle").groupBy("k1").agg(F.collect_set(F.struct("place", "shingle", "blocks")).alias("lists"))
                     .join(classes, "k1").select("id", "n", "bits", "lists"), "listed")
    st.drop("prefix", "shared")

    def entries(answers: DataFrame) -> DataFrame:
        e = answers.select("id", "n", "bits", "lists", "answer").mapInArrow(_entries, _ENTRY)
        e = e.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return (e.select("shingle", F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi"), "block", "id", "n", "place", "before1", "before2", "bits", "answer")
                .repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi", "n", "id"))

    near = entries(listed.withColumn("answer", F.lit(0).cast("long"))).mapInArrow(_first_round(percent), "a long, b long, kind int, w long")
    picks = near.groupBy("a", "kind").agg(F.min(F.struct("w", "b"))["b"].alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    picks = st.keep(picks, "picks")
    sure = _linked(st, "sure", picks, src, classes, k, percent)
    answers = components(st, sure, "a", "b", "first")
    known = listed.join(answers.withColumnRenamed("v", "id"), "id", "left").withColumn("answer", F.coalesce("m", "id"))
    rest = entries(known).mapInArrow(_second_round(percent), "a long, b long").distinct()
    tried = picks.select("a", "b")
    rest = st.keep(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    st.drop("listed", "picks")
    links = sure.union(_linked(st, "more", rest, src, classes, k, percent))
    root = components(st, links, "a", "b", "second")
    named = classes.select("id", "k1", "k2", "first_id", "copies").join(root.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("m", "id"))
    component = named.groupBy("root").agg(F.min("first_id").alias("component"))  # null if no document of it has an id
    named = st.hold(named.join(component, "root").select("k1", "k2", "component", "copies"))
    out = st.hold(rows.select("doc_id", "k1", "k2", "n").join(named, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("class_size")))
    st.drop(*list(st.paths))
    return out
