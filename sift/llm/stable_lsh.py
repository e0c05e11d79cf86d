"""Operator 8: embedding near-duplicates by Euclidean p-stable hashing.

Equal vectors are one class.  Classes are normalised and bucketed in several
tables by quantised random projections; members of a bucket are compared by
exact cosine in double precision.  The number of projections grows with the
logarithm of the number of classes, so that a bucket holds a bounded number of
unrelated vectors, and the number of tables follows from ``RECALL``: the
probability that a pair at exactly the threshold meets in some table.

1. Only (bucket, class, sign sketch) rows are shuffled at first.  A member goes
   on if the sketch of another member of its bucket is near (a pair at the
   threshold is passed over with a probability below 0.0001).
2. The vectors of those members are fetched to their buckets and compared.  A
   pair counts in the first table in which it meets, so links are counted once.

Buckets longer than ``BLOCK`` are split into blocks and block pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, their own component, kept); vectors of
different dimension are never compared; every row is a vector of its own,
whether its id is repeated or null; a component's id is the smallest id of its
vectors (null if none has one); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .flow import Stage, _forest, components
from .near_sets import _complete

COSINE, RECALL, WIDTH, SEED, BLOCK = 0.9, 0.94, 2.0, 8, 4096
LEAST_PROJECTIONS, UNRELATED = 10, 200  # projections of a small table; unrelated vectors of a bucket, about
SKETCH = 128                            # bits


def collision(distance: float, width: float) -> float:
    """Probability that one projection puts two vectors of that distance into the same cell."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def shape(n: int, cosine: float, recall: float, width: float) -> tuple[int, int]:
    """(tables, projections) for n classes."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    projections = max(LEAST_PROJECTIONS, math.ceil(math.log(max(n / UNRELATED, 1)) / -math.log(far)))
    return math.ceil(math.log(1 - recall) / math.log(1 - near ** projections)), projections


def reach(cosine: float) -> int:
    """Sketch bits in which a pair at the threshold may differ (four standard deviations)."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p)))


def _projections(dim: int, tables: int, projections: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim, tables, projections])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections), rng.standard_normal((dim, SKETCH))


def bucket_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x tables bucket keys: 32 bits of the hashed quantised projections, rows x 2 words of sign sketch)."""
    a, b, s = _projections(x.shape[1], tables, projections, width, seed)
    q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections)
    h = np.full(q.shape[:2], x.shape[1], np.uint64)
    for k in range(projections):
        h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + q[:, :, k].astype(np.uint64))
    sketch = np.packbits(x @ s > 0, axis=1).view(np.uint64)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32), sketch


def _units(col: pa.Array):
    """(rows, unit vectors) by dimension of a list column."""
    size = np.asarray(col.value_lengths()).astype(np.int64)
    flat, at = np.asarray(col.flatten()).astype(np.float64), np.concatenate([[0], np.cumsum(size)])
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        x = flat[at[rows][:, None] + np.arange(dim)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(tables: int, projections: int, width: float, seed: int):
    def run(batches):
        for batch in batches:
            for rows, x in _units(batch.column(1)):
                keys, sketch = bucket_keys(x, tables, projections, width, seed)
                s = tk.signed(np.ascontiguousarray(sketch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), tk.list_array(keys.ravel(), np.arange(0, keys.size + 1, tables)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())],
                    ["id", "keys", "s1", "s2"])
    return run


def _groups(table: pa.Table):
    """Bounds of the buckets (or block pairs) of a table sorted by them."""
    col = [np.asarray(table[c].combine_chunks()) for c in ("table", "key", "lo", "hi")]
    edge = np.ones(len(col[0]), bool)
    edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in col])
    starts = np.append(np.flatnonzero(edge), len(edge))
    return zip(starts[:-1].tolist(), starts[1:].tolist())


def _plausible(most: int):
    """Members of a bucket whose sketch is near another member's."""
    def run(batches):
        for table in _complete(batches, ["table", "key", "lo", "hi"]):
            lo, hi, block = (np.asarray(table[c].combine_chunks()) for c in ("lo", "hi", "block"))
            s1, s2 = (np.asarray(table[c].combine_chunks()).view(np.uint64) for c in ("s1", "s2"))  # bits are counted of unsigned words
            keep = np.zeros(len(s1), bool)
            for a, b in _groups(table):
                for s in range(a, b, 256):
                    e = min(s + 256, b)
                    gap = np.bitwise_count(s1[s:e, None] ^ s1[None, a:b]).astype(np.int64) + np.bitwise_count(s2[s:e, None] ^ s2[None, a:b])
                    near = gap <= most
                    near[np.arange(e - s), np.arange(s - a, e - a)] = False
                    if lo[a] != hi[a]:
                        near &= block[s:e, None] != block[None, a:b]
                    keep[s:e] = near.any(axis=1)
            yield from table.filter(pa.array(keep)).select(["id", "table", "key", "lo", "hi", "block"]).combine_chunks().to_batches()
    return run


def _linked(cosine: float):
    """Buckets -> per class the copies it links with (kind 0) and a spanning forest of the links (kind 1)."""
    def run(batches):
        for table in _complete(batches, ["table", "key", "lo", "hi"]):
            col = lambda c: np.asarray(table[c].combine_chunks()).astype(np.int64)
            t, lo, hi, block, ids, copies = (col(c) for c in ("table", "lo", "hi", "block", "id", "copies"))
            keys = np.asarray(table["keys"].combine_chunks().flatten()).reshape(len(t), -1)
            units, dim, x = [None] * len(t), np.zeros(len(t), np.int64), table["v"].combine_chunks()
            for rows, u in _units(x):
                dim[rows] = u.shape[1]
                for r, v in zip(rows.tolist(), u):
                    units[r] = v
            out_i, out_j = [], []
            for a, b in _groups(table):
                for d in np.unique(dim[a:b]).tolist():
                    own = a + np.flatnonzero(dim[a:b] == d)
                    if len(own) < 2:
                        continue
                    x = np.stack([units[k] for k in own.tolist()])
                    for s in range(0, len(own), 128):
                        i, j = np.nonzero(x[s:s + 128] @ x.T >= cosine)
                        i, j = own[i + s], own[j]
                        ok = (i < j) & ((lo[i] == hi[i]) | (block[i] != block[j]))
                        i, j = i[ok], j[ok]
                        first = np.argmax(keys[i] == keys[j], axis=1) == t[i]  # the first table in which the pair meets
                        out_i.append(i[first])
                        out_j.append(j[first])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))
            if len(i) == 0:
                continue
            n = np.bincount(i, weights=copies[j], minlength=len(t)) + np.bincount(j, weights=copies[i], minlength=len(t))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(has), np.int32)), pa.array(ids[has]), pa.array(n[has].astype(np.int64))], ["kind", "a", "b"])
            for f in _forest([pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["v", "m"])]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(f.num_rows, np.int32)), f.column(0), f.column(1)], ["kind", "a", "b"])
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH, seed: int = SEED,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    st = Stage(vectors.sparkSession, "lsh")
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    src = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
           .withColumn("ok", F.coalesce(usable, F.lit(False))).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}))
    classes = src.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = st.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written with its numbers
    tables, projections = shape(classes.count(), cosine, recall, width)
    keyed = st.keep(classes.select("id", "v").mapInArrow(_hashed(tables, projections, width, seed), "id long, keys array<int>, s1 long, s2 long"), "keyed")
    narrow = keyed.select("id", "s1", "s2", F.posexplode("keys").alias("table", "key"))
    shared = narrow.groupBy("table", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("table", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    shared = st.keep(shared, "shared")  # as a table of its own, so that AQE can split the other side of the join

    def blocked(members: DataFrame) -> DataFrame:
        return (members.withColumn("block", F.pmod("id", "blocks").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")}).drop("blocks", "_o"))

    pairs = ["table", "key", "lo", "hi"]
    members = blocked(narrow.join(shared, ["table", "key"])).repartition(*pairs).sortWithinPartitions(*pairs).select("id", *pairs, "block", "s1", "s2")
    likely = st.keep(members.mapInArrow(_plausible(reach(cosine)), "id long, table int, key int, lo int, hi int, block int"), "likely")
    st.drop("shared")
    rows = likely.join(keyed.select("id", "keys"), "id").join(classes.select("id", "copies", "v"), "id")
    found = st.keep(rows.repartition(*pairs).sortWithinPartitions(*pairs, "id").mapInArrow(_linked(cosine), "kind int, a long, b long"), "found")
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    root = components(st, found.where("kind = 1"), "a", "b")
    named = classes.select("id", "k1", "k2", "copies", "first_id").join(links, "id", "left").join(root.withColumnRenamed("v", "id"), "id", "left").withColumn(
        "root", F.coalesce("m", "id"))
    component = named.groupBy("root").agg(F.min("first_id").alias("component"))  # null if no vector of it has an id
    named = named.join(component, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component", F.lit(True).alias("ok"))
    out = st.hold(src.select("vec_id", "ok", "k1", "k2").join(named, ["ok", "k1", "k2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    st.drop(*list(st.paths))
    return out
