"""Operator 5: exact substring dedup by threshold-bounded interval expansion.

Removes every byte covered by a ``length``-byte string that starts anywhere
else in the corpus too.

1. Anchors.  The smallest of a window's 64-byte grams (by hash, leftmost on
   ties) depends on the window's content alone, so equal windows have equal
   anchors.  The windows of one anchor are neighbours; with their bytes they
   form the anchor's context.  Only hashes of anchors and contexts are shuffled.
2. An anchor seen once rules all its windows out; equal contexts repeat whole.
   What remains are anchors with several different contexts.
3. Those contexts, once each, are dealt by anchor and indexed in batches: a
   suffix order over 8-byte symbols and its Burrows-Wheeler transform.  Intervals
   of equal prefixes are expanded breadth-first by backward extension: a row's
   common prefix with its neighbour grows by one symbol while no boundary found
   so far lies between the rows they lead to; boundaries appear by increasing
   prefix value and the expansion stops at ``length`` bytes.  Windows left in an
   interval with another window are repeated.
4. Anchors with more than ``HOT_CONTEXTS`` different contexts are split by the
   content of their windows (hashes, pre-aggregated), so none fills one task.

Defined results: null text is empty; text shorter than ``length`` stays; rows
repeated in the input are repeats of each other; the order of rows, null ids
and extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .flow import Stage
from .near_sets import _complete

LENGTH, GRAM, STEP = 200, 64, 8
HOT_CONTEXTS = 16_384
MEMBERS, SHORT = 1000, 64  # places of a context in one list, about; in the parts of a list that are dealt apart
BATCH_BYTES = 1 << 20
_PLACE = np.uint64((1 << 32) - 1)  # places in a text of any size that a column holds


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(len(data) - size + 1)
    return tk.span_hash(data, at, at + size)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (block prefix and suffix minima)."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    b = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(b, axis=1).ravel()
    return np.minimum(left[:n - w + 1], right[w - 1:n])


def anchors(data: np.ndarray, off: np.ndarray, length: int):
    """(document, first window, windows, anchor hash, context hash) of every anchor; windows count from their document."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    h = _gram_hashes(data, GRAM)
    low = _window_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & _PLACE
    inside = np.zeros(n + 1, np.int8)  # windows that end in their document
    long = np.flatnonzero(np.diff(off) >= length)
    inside[off[long]] += 1
    inside[off[long + 1] - length + 1] -= 1
    s = np.flatnonzero(np.cumsum(inside[:n - length + 1]))
    a = low[s].astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    doc = np.searchsorted(off, s, "right") - 1
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    start = s[first]
    return doc[first], start - off[doc[first]], count, h[a[first]], tk.span_hash(data, start, start + count - 1 + length)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With the key of a row's id and text: rows without id, or with one id, are spread by their texts."""
    return docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "text_key": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(2))
            ids, keys = batch.column(0), batch.column(1)
            for i, j in tk.slices(off):
                doc, first, count, a, c = anchors(*tk.cut(data, off, i, j), length)
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(tk.signed(a)), pa.array(tk.signed(c))], ["_id", "text_key", "first", "n", "anchor", "context"])
    return run


def _context_bytes(length: int):
    """Documents with the contexts they lend -> (anchor, context, hot, bytes).  Of equal rows side by side one lends."""
    def run(batches):
        last = None
        for batch in batches:
            data, off = tk.text_bytes(batch.column(2))
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [k != before for k, before in zip(keys, [last, *keys])]
            last = keys[-1] if keys else last
            lent = batch.column(3)
            for i, j in tk.slices(off):
                own, at = tk.cut(data, off, i, j)
                rows = [(x["anchor"], x["context"], x["hot"], own[at[r] + x["first"]:at[r] + x["first"] + x["n"] - 1 + length].tobytes())
                        for r in range(j - i) if new[i + r] for x in lent[i + r].as_py()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["anchor", "context", "hot", "bytes"])
    return run


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank of each item)."""
    by = np.argsort(key)
    s = key[by]
    rank = np.empty(len(key), np.int64)
    rank[by] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    return by, rank


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``valid`` positions start a ``length``-byte string that another valid position starts too."""
    n, steps = len(text), length // STEP
    reach = 1
    while reach < steps:
        reach *= 2
    padded = np.concatenate([text, np.zeros(STEP * reach + STEP, np.uint8)])
    symbol = np.zeros(n, np.uint64)
    for k in range(STEP):
        symbol = (symbol << np.uint64(8)) | padded[k:k + n]
    order, rank = _ranks(symbol)
    first = rank
    size = STEP
    while size < length:  # suffix order by prefix doubling, as deep as the threshold
        after = np.zeros(n, np.int64)
        after[:n - size] = rank[size:] + 1
        order, rank = _ranks(rank * (n + 1) + after)
        size *= 2
    # the transform: the symbol before each row's suffix; before the first bytes stands a symbol of its own
    before = np.full(n, int(first.max()) + 1, np.int64)
    inner = order >= STEP
    before[inner] = first[order[inner] - STEP]
    occurs = np.argsort(before, kind="stable")  # rows by symbol: a symbol's k-th occurrence extends to the k-th row of its block
    count = np.bincount(before, minlength=int(first.max()) + 2)
    block = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=len(count)))])[:-1]
    skip = np.bincount(first, minlength=len(count)) - count  # suffixes without a byte after their symbol come first in its block
    extended = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + np.repeat(block + np.maximum(skip, 0), count)
    extended, occurs = extended[:n - int(count[-1])], occurs[:n - int(count[-1])]
    leads = np.full(n, -1, np.int64)  # the row whose backward extension a row is
    leads[extended] = occurs
    boundary = np.ones(n, bool)
    f = first[order]
    boundary[1:] = f[1:] != f[:-1]
    active = np.flatnonzero(~boundary)
    lo, hi = leads[active - 1], leads[active]
    for _ in range(steps - 1):  # common prefixes of 8, 16, ... bytes
        below = np.cumsum(boundary)
        ends = (lo < 0) | (hi < 0) | (below[hi] != below[lo])
        if not ends.any():
            continue
        boundary[active[ends]] = True
        active, lo, hi = active[~ends], lo[~ends], hi[~ends]
    interval = np.cumsum(boundary) - 1
    ok = valid[order]
    many = np.bincount(interval[ok], minlength=int(interval[-1]) + 1) >= 2
    out = np.zeros(n, bool)
    out[order] = ok & many[interval]
    return out


def _expand(length: int):
    """Contexts of whole anchors -> (anchor, context, from, to): ranges of repeated windows."""
    def run(batches):
        for table in _complete(batches, ["anchor"]):
            anchor, context = (np.asarray(table[c].combine_chunks()) for c in ("anchor", "context"))
            once = np.ones(len(anchor), bool)
            once[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
            table = table.filter(pa.array(once))
            anchor, context = anchor[once], context[once]
            col = table["bytes"].combine_chunks()
            size = np.asarray(pa.compute.binary_length(col)).astype(np.int64)
            ends = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) + 1
            total = np.concatenate([[0], np.cumsum(size)])
            a = 0
            while a < len(anchor):
                e = int(np.searchsorted(total[ends], total[a] + BATCH_BYTES, "right"))
                b = int(ends[max(e - 1, np.searchsorted(ends, a, "right"))])
                text = np.frombuffer(b"".join(col.slice(a, b - a).to_pylist()), np.uint8)
                at = total[a:b + 1] - total[a]
                valid = np.ones(len(text) + 1, np.int8)
                left = np.zeros(len(text) + 1, np.int64)
                left[at[:-1]] += 1
                left[at[1:] - length + 1] -= 1
                valid = np.cumsum(left)[:-1] > 0
                s, t, row = tk.runs(repeated_starts(text, valid, length), at)
                if len(row):
                    rows, begin = np.unique(row, return_index=True)
                    cuts = np.append(begin, len(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[a + rows]), pa.array(context[a + rows]), tk.list_array((s - at[row]).astype(np.int32), cuts), tk.list_array((t - at[row]).astype(np.int32), cuts)],
                        ["anchor", "context", "from", "to"])
                a = b
    return run


def _window_hashes(length: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = np.frombuffer(batch.column(2)[k].as_py(), np.uint8)
                h = tk.signed(_gram_hashes(text, length))
                m = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * m, pa.int64()), pa.array([batch.column(1)[k].as_py()] * m, pa.int64()),
                                                  pa.array(np.arange(m, dtype=np.int32)), pa.array(h)], ["anchor", "context", "j", "window"])
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, text_key, spans): for each text with repeats under an id its (lo, hi) runs of window starts.  docs: doc_id, text."""
    if length % STEP or length <= GRAM:
        raise ValueError(f"length must be a multiple of {STEP} above {GRAM}")
    st = Stage(docs.sparkSession, "suffix")
    src = _keyed(docs, "doc_id", "text").select("_id", "text_key", "text")
    rows = st.keep(src.mapInArrow(_anchor_rows(length), "_id long, text_key long, first int, n int, anchor long, context long"), "anchors")
    again = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("c > 1").select(
        "anchor", "c", (F.col("lo") != F.col("hi")).alias("mixed"))
    again = st.keep(again, "again")  # as a table of its own, so that AQE can split the other side of the join
    seen = st.keep(rows.join(again, "anchor"), "seen")
    st.drop("anchors", "again")
    place = F.struct("_id", "text_key", "first", "n")
    part = F.pmod(F.xxhash64("_id", "text_key", "first"), F.ceil(F.col("c") / MEMBERS)).alias("part")
    members = (seen.where("mixed").groupBy("anchor", "context", part)
               .agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("r"), F.collect_list(place).alias("places")))
    members = st.keep(members, "members")  # a context's places in lists of about MEMBERS at most
    contexts = st.keep(members.groupBy("anchor", "context").agg(F.sum("c").alias("c"), F.min("r").alias("r")), "contexts")
    hot = st.keep(contexts.groupBy("anchor").agg((F.count(F.lit(1)) > HOT_CONTEXTS).alias("hot")), "hot")
    lent = (contexts.join(hot, "anchor").groupBy("r._id", "r.text_key")
            .agg(F.collect_list(F.struct("r.first", "r.n", "anchor", "context", "hot")).alias("lent")))
    pieces = (src.join(lent, ["_id", "text_key"]).select("_id", "text_key", "text", "lent")
              .mapInArrow(_context_bytes(length), "anchor long, context long, hot boolean, bytes binary"))
    pieces = st.keep(pieces, "pieces")
    ranges = "anchor long, context long, from array<int>, to array<int>"
    found = (pieces.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "context").select("anchor", "context", "bytes")
             .mapInArrow(_expand(length), ranges))
    windows = (pieces.where("hot").select("anchor", "context", "bytes").mapInArrow(_window_hashes(length), "anchor long, context long, j int, window long")
               .dropDuplicates(["context", "j", "window"]))
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("window")
    found_hot = (windows.join(twice, "window").groupBy("anchor", "context").agg(F.array_sort(F.collect_set("j")).alias("from"))
                 .select("anchor", "context", "from", F.transform("from", lambda x: x + 1).alias("to")))
    found = contexts.select("anchor", "context", (F.col("c") > 1).alias("full")).join(found.unionByName(found_hot), ["anchor", "context"], "left")
    found = st.keep(found.where("full OR from IS NOT NULL"), "found")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to")))
    cut = lambda c: c.select("_id", "text_key", "first", F.explode("parts").alias("p"))
    plain = cut(seen.where("NOT mixed").withColumn("parts", whole))
    listed = members.select("anchor", "context", "part", "places").join(found, ["anchor", "context"])
    short = F.transform(F.sequence(F.lit(0), F.floor((F.size("places") - 1) / SHORT).cast("int")), lambda i: F.slice("places", i * SHORT + 1, SHORT))
    listed = listed.select("anchor", "context", "part", F.posexplode(short).alias("at", "some"), "full", "from", "to")
    listed = listed.repartition("anchor", "context", "part", "at").select(F.explode("some").alias("x"), "full", "from", "to")  # a context's lists apart
    mixed = cut(listed.select("x.*", "full", "from", "to").withColumn("parts", F.when(F.col("full"), whole).otherwise(F.arrays_zip("from", "to"))))
    spans = (plain.unionByName(mixed).groupBy("_id", "text_key")
             .agg(F.collect_set(F.struct((F.col("first") + F.col("p.from")).alias("lo"), (F.col("first") + F.col("p.to")).alias("hi"))).alias("spans")))
    spans = st.hold(spans)
    st.drop(*list(st.paths))
    return spans


def _removed(text: np.ndarray, spans, length: int) -> np.ndarray:
    """Flags of the bytes to remove."""
    cover = np.zeros(len(text) + 1, np.int64)
    for s in spans or ():
        cover[s["lo"]] += 1
        cover[s["hi"] - 1 + length] -= 1
    return np.cumsum(cover)[:-1] > 0


def _finish(length: int, at: int, spans_at: int, as_text: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            data, off = tk.text_bytes(batch.column(at))
            spans = batch.column(spans_at).to_pylist()
            kept, digest = [], []
            for i, j in tk.slices(off):
                own, o = tk.cut(data, off, i, j)
                for r in range(j - i):
                    text = own[o[r]:o[r + 1]]
                    gone = _removed(text, spans[i + r], length) if spans[i + r] else np.zeros(len(text), bool)
                    rest = text[~gone].tobytes()
                    if as_text:
                        kept.append(None if batch.column(at)[i + r].as_py() is None else rest.decode("utf-8", "ignore"))
                    else:
                        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
                        digest.append((len(text), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
            if as_text:
                cols = [pa.array(kept, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns) if k != spans_at]
                yield pa.RecordBatch.from_arrays(cols, names)
            else:
                parts = zip(*digest) if digest else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, t) for p, t in zip(parts, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names)
    return run


def dedup_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = _keyed(src, "doc_id", "text").join(repeated_spans(src, length), ["_id", "text_key"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return joined.mapInArrow(_finish(length, 1, 2, False, names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes removed from the text (a code point cut in part goes whole)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    own = _keyed(own, f"_c{docs.columns.index(id_col)}", f"_c{docs.columns.index(text_col)}")
    joined = own.join(repeated_spans(src, length), ["_id", "text_key"], "left").drop("_id", "text_key")
    names = joined.columns[:-1]
    schema = T.StructType(joined.schema.fields[:-1])
    out = joined.mapInArrow(_finish(length, docs.columns.index(text_col), len(names), True, names), schema)
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
