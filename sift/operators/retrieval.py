"""Vector retrieval over a chunk table, for a whole table of queries.

Exact k-nearest search is a block join without a product of rows.  Corpus rows
are dealt once to cells by a hash of their id, every query goes to every cell.
A task streams its cell in Arrow batches, scores each batch with one numpy
matrix product and keeps a running top ``k`` per query.  Up to ``QUERY_BLOCK``
queries are held and the corpus streams past them; more queries stream past the
rows of (smaller) cells.  Either way a corpus row is shuffled once, nothing
passes through the driver, and a final ``row_number() <= k`` merges the cells.

Products are made in single precision and only pairs that may be among the
``k`` nearest (by a bound on the rounding error) are measured in double.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package

QUERY_BLOCK = 20_000     # queries held by a task at most (10 MB at dim 64)
HELD_VALUES = 36_000_000 # with more queries a task holds corpus rows of so many values (288 MB of vectors) and queries stream past
CELL_QUERIES = 400_000   # more queries than this, counted in every cell, go to as few cells as that
QUERY_TILE = 256         # queries scored per matrix product inside a batch
ROW_TILE = 2048          # corpus rows per single-precision product: 2 MB of products, which stay in the core's cache
SPARSE_ROWS = 131_072    # corpus rows of term lists scored together (1 MB of scores of a query)
ROW_VALUES = 32          # values of a row on average at most among those
FEW_ROWS = 16_384        # fewer rows are scored for many queries at once
TILE_VALUES = 1_000_000  # scores made at once then
FILTER_BITS = 24         # log2 of the bits of a filter of hit ids
METRICS = ("cosine", "l2", "ip")
RANK_DECIMALS = 9        # ranking key: distance rounded, then id (engine-independent ties)


def _distances(V: np.ndarray, Q: np.ndarray, metric: str, vn: np.ndarray, qn: np.ndarray) -> np.ndarray:
    S = V @ Q.T
    if metric == "cosine":
        den = vn[:, None] * qn[None, :]
        cos = np.divide(S, den, out=np.zeros_like(S), where=den > 0)
        return 1.0 - cos
    if metric == "l2":
        return np.maximum((vn * vn)[:, None] + (qn * qn)[None, :] - 2.0 * S, 0.0)
    return 1.0 - S


def _topk_rows(rd: np.ndarray, ids: np.ndarray, k: int):
    """Per column of ``rd`` (n x q) the rows of the ``k`` smallest by (rd, id).

    Returns (row_index, query_index) arrays.  Rows must be sorted by id.
    """
    n, q = rd.shape
    if n <= k:
        r, c = np.nonzero(np.ones_like(rd, dtype=bool))
        return r, c
    part = np.partition(rd, k - 1, axis=0)
    kth = part[k - 1]
    mask = rd <= kth[None, :]
    counts = mask.sum(axis=0)
    over = np.nonzero(counts > k)[0]
    for j in over:               # ties at the k-th value: keep the smallest ids
        col = rd[:, j]
        order = np.lexsort((ids, col))[:k]
        m = np.zeros(n, dtype=bool)
        m[order] = True
        mask[:, j] = m
    r, c = np.nonzero(mask)
    return r, c


SEED_ROWS = 1024         # corpus rows measured in full before there is a bound
DENSE = 0.1              # queries with a larger share of a batch within their bound are measured in full


class _Near:
    """Corpus rows of a batch prepared for the single-precision products: ``near`` finds the pairs within a bound."""

    def __init__(self, v: np.ndarray, vn: np.ndarray, metric: str):
        self.metric, self.most, self.slack = metric, float(vn.max(initial=0.0)), (v.shape[1] + 16) * 2.0 ** -23
        if metric == "cosine":
            v = np.divide(v, vn[:, None], out=np.zeros_like(v), where=vn[:, None] > 0)
        elif metric == "l2":
            v = np.concatenate([v, -0.5 * (vn * vn)[:, None]], axis=1)
        self.v = v.astype(np.float32)

    def near(self, q: np.ndarray, qn: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(corpus x query) flags: False only where the distance is over the query's bound."""
        if self.metric == "cosine":
            q = np.divide(q, qn[:, None], out=np.zeros_like(q), where=qn[:, None] > 0)
            least = 1.0 - bound - self.slack
        elif self.metric == "l2":
            q = np.concatenate([q, np.ones((len(q), 1))], axis=1)
            least = 0.5 * (qn * qn - bound) - self.slack * (self.most * qn + self.most * self.most + qn * qn)
        else:
            least = 1.0 - bound - self.slack * (self.most * qn + 1.0)
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        out, q = np.empty((len(self.v), len(q)), bool), q.T.astype(np.float32)
        for lo in range(0, len(self.v), ROW_TILE):
            np.greater_equal(self.v[lo:lo + ROW_TILE] @ q, least[None, :], out=out[lo:lo + ROW_TILE])
        return out


def _where(flags: np.ndarray) -> np.ndarray:
    """Places of the few set flags, eight at a time."""
    flat = flags.ravel()
    m = len(flat) // 8 * 8
    cells = (np.flatnonzero(flat[:m].view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([cells[flat[cells]], np.flatnonzero(flat[m:]) + m])


def _plain(norms: np.ndarray) -> bool:
    """Whether single precision holds vectors of these norms (finite, neither huge nor tiny)."""
    return bool(np.isfinite(norms).all() and ((norms == 0) | ((norms > 1e-9) & (norms < 1e9))).all())


def _vectors(col: pa.Array, dim: int | None) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(col.value_lengths())
    if len(size) and (size != (dim or size[0])).any():
        raise ValueError("vectors have different lengths")
    return flat.reshape(len(col), -1)


def _ids(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False) if pa.types.is_integer(col.type) else np.array(col.to_pylist())


class _TopK:
    """Queries of one cell and their running nearest corpus rows (smallest rounded distance, then id)."""

    gather = 1           # corpus rows that are measured together at least

    def __init__(self, k: int, metric: str, carry: bool, together: bool = False):
        self.k, self.metric, self.carry, self.together = k, metric, carry, together
        self.parts: list = []
        self.qids = None
        self.best: tuple | None = None  # (query number, rounded distance, id, distance, vector), the rows of a query together and sorted
        self.bound: np.ndarray | None = None
        self.dim: int | None = None
        self.seen = 0        # corpus rows measured so far

    def add_queries(self, qids: pa.Array, cols: list[pa.Array]) -> None:
        v = _vectors(cols[0], self.dim)
        self.dim = v.shape[1]
        self.parts.append((qids, v))

    def _ready(self) -> bool:
        if self.qids is None and self.parts:
            self.qids = pa.concat_arrays([p[0] for p in self.parts])
            self._prepare([p[1] for p in self.parts])
        return self.qids is not None

    def _prepare(self, parts: list) -> None:
        self.q = np.concatenate(parts)
        self.qn = np.linalg.norm(self.q, axis=1)
        self.plain = _plain(self.qn)

    def rows(self, parts: list) -> tuple:
        """Corpus rows (ids, columns) made ready to be measured: (ids, vectors, norms), sorted by id."""
        ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([_vectors(p[1][0], self.dim) for p in parts])
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        return ids, v, np.linalg.norm(v, axis=1)

    def add_corpus(self, ids: np.ndarray, cols: list[pa.Array]) -> None:
        self.add_rows(self.rows([(ids, cols)]))

    def add_rows(self, rows: tuple) -> None:
        if not self._ready():
            return
        ids, v, vn = rows
        if v.shape[1] != self.dim and len(v):
            raise ValueError("vectors have different lengths")
        if self.bound is None or not self.plain or not _plain(vn):
            n = len(v) if not (self.plain and _plain(vn)) else max(SEED_ROWS, self.k)
            self._measure(v[:n], vn[:n], ids[:n], np.arange(len(self.q)))
            self.seen += min(n, len(v))
            v, vn, ids = v[n:], vn[n:], ids[n:]
        while len(v):  # few rows at first, whose hits bring the bounds down for more rows
            n = max(SEED_ROWS, self.seen)
            self._add_near(v[:n], vn[:n], ids[:n])
            self.seen += min(n, len(v))
            v, vn, ids = v[n:], vn[n:], ids[n:]

    def _add_near(self, v: np.ndarray, vn: np.ndarray, ids: np.ndarray) -> None:
        rows, found = _Near(v, vn, self.metric), []
        # queries in tiles: a batch x tile block of products stays ~ QUERY_TILE x batch floats
        for lo in range(0, len(self.q), QUERY_TILE):
            hi = min(lo + QUERY_TILE, len(self.q))
            near = rows.near(self.q[lo:hi], self.qn[lo:hi], self.bound[lo:hi])
            at = _where(near)
            if len(at) > DENSE * len(v):  # there may be queries with many rows as near as their k-th
                dense = near.sum(axis=0) > max(DENSE * len(v), 4 * self.k)
                if dense.any():
                    near[:, dense] = False
                    at = _where(near)
                    found.append(self._full(v, vn, ids, np.flatnonzero(dense) + lo))
            r, c = at // (hi - lo), at % (hi - lo) + lo
            d = self._pairs(v[r], vn[r], c)
            rd = np.round(d, RANK_DECIMALS)
            on = rd <= self.bound[c]
            r, c = r[on], c[on]
            found.append((c, rd[on], ids[r], d[on], v[r] if self.carry else np.zeros((len(r), 0))))
        if any(len(f[0]) for f in found):
            self._merge(found)

    def _pairs(self, v: np.ndarray, vn: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of corpus rows from the queries ``c``, pair by pair."""
        s, qn = np.einsum("ij,ij->i", v, self.q[c]), self.qn[c]
        if self.metric == "cosine":
            return 1.0 - np.divide(s, vn * qn, out=np.zeros_like(s), where=vn * qn > 0)
        return np.maximum(vn * vn + qn * qn - 2.0 * s, 0.0) if self.metric == "l2" else 1.0 - s

    def _full(self, v: np.ndarray, vn: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple:
        """The nearest rows of the queries ``which`` among these, all pairs measured."""
        d = _distances(v, self.q[which], self.metric, vn, self.qn[which])
        rd = np.round(d, RANK_DECIMALS)
        r, c = _topk_rows(rd, ids, self.k)
        return which[c], rd[r, c], ids[r], d[r, c], v[r] if self.carry else np.zeros((len(r), 0))

    def _measure(self, v: np.ndarray, vn: np.ndarray, ids: np.ndarray, which: np.ndarray) -> None:
        self._merge([self._full(v, vn, ids, which[lo:lo + QUERY_TILE]) for lo in range(0, len(which), QUERY_TILE)])

    def _merge(self, found: list) -> None:
        rest = None
        if self.best is not None:  # only queries with new rows are sorted again
            new = np.zeros(len(self.qids), bool)
            for f in found:
                new[f[0]] = True
            mine = new[self.best[0]]
            found.append(tuple(x[mine] for x in self.best))
            rest = tuple(x[~mine] for x in self.best)
        else:
            self.bound = np.full(len(self.qids), np.inf)  # the k-th distance of every query that has k rows
        qi, rd, own, d, vec = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((rd, qi))
        rq, rr = qi[by], rd[by]
        same = (rq[1:] == rq[:-1]) & ((rr[1:] == rr[:-1]) | (np.isnan(rr[1:]) & np.isnan(rr[:-1])))
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(by) else by
        part = by[tied]  # ids may be long strings: only those of equal distances are compared
        by[tied] = part[np.lexsort((own[part], rd[part], qi[part]))]
        first = np.searchsorted(qi[by], np.arange(len(self.qids)))
        keep = by[np.arange(len(by)) - first[qi[by]] < self.k]
        kept = (qi[keep], rd[keep], own[keep], d[keep], vec[keep])
        n = np.bincount(qi[keep], minlength=len(self.qids))
        full = np.flatnonzero(n >= self.k)
        self.bound[full] = rd[keep][np.cumsum(n)[full] - 1]
        self.best = kept if rest is None else tuple(np.concatenate(x) for x in zip(rest, kept))


def _term_lists(cols: list, order: np.ndarray | None = None) -> tuple:
    """Term and weight lists, put in order: (encoded terms, weights, sizes)."""
    lists = [pa.concat_arrays([c[i] for c in cols]) for i in range(2)]
    if order is not None:
        lists = [x.take(pa.array(order)) for x in lists]
    return lists[0].flatten().dictionary_encode(), np.asarray(lists[1].flatten()).astype(np.float64), np.asarray(lists[0].value_lengths().fill_null(0)).astype(np.int64)


class _SparseTopK(_TopK):
    """The same for term weights: the score is the sum of products over shared terms, largest first, above 0 only.

    With ``together`` rows of one id, which come next to each other, are one row.
    """

    def add_queries(self, qids: pa.Array, cols: list[pa.Array]) -> None:
        self.parts.append((qids, cols))

    gather = SPARSE_ROWS

    def _prepare(self, parts: list) -> None:
        terms, weights, size = _term_lists([c for c in parts])
        self.names = terms.dictionary.to_pylist()
        row, col = np.repeat(np.arange(len(size)), size), np.asarray(terms.indices).astype(np.int64)
        last = len(row) - 1 - np.unique((row * max(len(self.names), 1) + col)[::-1], return_index=True)[1]  # a term that a query names twice counts once
        self.row, self.col, self.w = row[last], col[last], weights[last]
        self.starts = np.searchsorted(self.row, np.arange(len(size) + 1))

    def rows(self, parts: list) -> tuple:
        """Corpus rows as postings: (ids, range of every term, rows, weights); rows are numbered by id."""
        ids = np.concatenate([p[0] for p in parts])
        order = np.argsort(ids, kind="stable")
        terms, weights, size = _term_lists([p[1] for p in parts], order)
        code = np.asarray(terms.indices)
        n = len(terms.dictionary)
        by = np.argsort(code.astype(np.uint16) if n < 1 << 16 else code, kind="stable")
        ends = np.searchsorted(code[by], np.arange(n + 1)).tolist()
        spans = {t: (ends[i], ends[i + 1]) for i, t in enumerate(terms.dictionary.to_pylist())}
        ids, number = ids[order], np.arange(len(ids), dtype=np.int32)
        if self.together:
            new = np.append(True, ids[1:] != ids[:-1])
            ids, number = ids[new], (np.cumsum(new) - 1).astype(np.int32)
        return ids, spans, np.repeat(number, size)[by], weights[by]

    def add_rows(self, rows: tuple) -> None:
        if not self._ready() or not self.names:
            return
        ids, spans, row, w = rows
        span = np.array([spans.get(t, (0, 0)) for t in self.names], np.int64)
        lo, hi = span[self.col, 0], span[self.col, 1]
        on = np.flatnonzero(hi > lo)  # the query terms that these rows have
        if not len(on):
            return
        lo, hi, x, starts = lo[on], hi[on], self.w[on], np.searchsorted(on, self.starts)
        found, n = [], len(ids)
        if n < FEW_ROWS:
            tile = max(1, TILE_VALUES // n)
            for a in range(0, len(self.starts) - 1, tile):
                b = min(a + tile, len(self.starts) - 1)
                p, q = starts[a], starts[b]
                if p < q:
                    found += self._tile(a, b, self.row[on[p:q]], lo[p:q], hi[p:q], x[p:q], row, w, ids)
        else:
            lo, hi, x, starts = lo.tolist(), hi.tolist(), x.tolist(), starts.tolist()
            for j in range(len(starts) - 1):
                mine = range(starts[j], starts[j + 1])
                if mine:
                    score = np.bincount(np.concatenate([row[lo[i]:hi[i]] for i in mine]),
                                        weights=np.concatenate([w[lo[i]:hi[i]] * x[i] for i in mine]), minlength=n)
                    found.append(self._best(j, score, ids))
        found = [f for f in found if len(f[0])]
        if found:
            self._merge(found)

    def _tile(self, a: int, b: int, query, lo, hi, x, row, w, ids) -> Iterator[tuple]:
        """Hits of the queries from ``a`` to ``b`` among few rows, all their products made at once."""
        size, n = hi - lo, len(ids)
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        score = np.bincount(np.repeat((query - a) * n, size) + row[at], weights=w[at] * np.repeat(x, size), minlength=(b - a) * n).reshape(b - a, n)
        return [self._best(int(j), score[j - a], ids) for j in np.unique(query)]

    def _best(self, j: int, score: np.ndarray, ids: np.ndarray) -> tuple:
        """The rows of largest score that may be among the query's ``k`` (equal scores: smallest ids)."""
        least = 0.0 if self.bound is None or not np.isfinite(self.bound[j]) else -self.bound[j] - 2.0 * 10.0 ** -RANK_DECIMALS
        hit = np.flatnonzero(score > max(least, 0.0))
        rd = -np.round(score[hit], RANK_DECIMALS)
        if len(hit) > self.k:
            on = np.flatnonzero(rd <= np.partition(rd, self.k - 1)[self.k - 1])
            on = on[np.argsort(rd[on], kind="stable")[:self.k]]
            hit, rd = hit[on], rd[on]
        return np.full(len(hit), j), rd, ids[hit], score[hit], np.zeros((len(hit), 0))


def score_cells(q: DataFrame, c: DataFrame, make: Callable[[], _TopK], id_col: str, value: str, carry: bool, partitions: int,
                even: bool = False) -> DataFrame:
    """``(qid, id, value[, _cv])``: at most k rows per query and cell (per Arrow batch of queries where the corpus is held).

    ``q``: (_cell, _side, _q, payload...), ``c``: (_cell, _side, _i, payload...);
    of each cell the side with ``_side`` 0 is held, the other streams past it.
    ``even``: cells are numbered from 0 and each has a task of its own.
    """
    spark = c.sparkSession
    ship_package(spark)
    qtype, itype = q.schema["_q"].dataType.simpleString(), c.schema["_i"].dataType.simpleString()
    payload = [x for x in c.columns if x not in ("_cell", "_side", "_i")]
    qr = q.select("_cell", "_side", F.lit(0).alias("_kind"), "_q", F.lit(None).cast(itype).alias("_i"), *payload)
    cr = c.select("_cell", "_side", F.lit(1).alias("_kind"), F.lit(None).cast(qtype).alias("_q"), "_i", *payload)
    both = qr.unionByName(cr)
    dealt = both.repartitionById(partitions, "_cell") if even else both.repartition(partitions, "_cell")
    rows = dealt.sortWithinPartitions("_cell", "_side", *(["_i"] if make().together else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top, held, id_arrow = None, None, [], None
        parts, rows = [], make()  # corpus rows that are not yet measured or held

        def found(top):
            if top is not None and top.best is not None:
                qi, _, ids, d, vec = top.best
                cols = [top.qids.take(pa.array(qi)), pa.array(ids.tolist(), id_arrow), pa.array(d)]
                if carry:
                    cols.append(pa.array(list(vec), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(cols, names=["qid", id_col, value, "_cv"][:len(cols)])

        def gathered(side, more=False):
            rest = []
            if more and rows.together:  # the last id may go on
                ids, cols = parts.pop()
                cut = int(np.flatnonzero(ids == ids[-1])[0])
                rest = [(ids[cut:], [x.slice(cut) for x in cols])]
                if cut:
                    parts.append((ids[:cut], [x.slice(0, cut) for x in cols]))
                elif parts and parts[-1][0][-1] == ids[0]:
                    parts.extend(rest)
                    return
            if parts and (side == 0 or top is not None):
                block = rows.rows(parts)
                held.append(block) if side == 0 else top.add_rows(block)
            parts[:] = rest

        for rb in batches:
            if rb.num_rows == 0:
                continue
            id_arrow = rb.column(4).type
            key = np.stack([np.asarray(rb.column(j)) for j in range(3)])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rb.num_rows]):
                cell, side, kind = key[:, a]
                if at != cell:
                    gathered(1)
                    yield from found(top)
                    at, top, held = cell, None, []
                part = rb.slice(a, b - a)
                if kind == 0:
                    if side:
                        gathered(0)
                    top = top or make()
                    top.add_queries(part.column(3), part.columns[5:])
                    if side:
                        for block in held:
                            top.add_rows(block)
                        yield from found(top)
                        top = None
                elif side == 0 or top is not None:
                    parts.append((_ids(part.column(4)), part.columns[5:]))
                    if sum(max(len(ids), len(cols[0].flatten()) // ROW_VALUES) for ids, cols in parts) >= rows.gather:
                        gathered(side, True)
        gathered(1)
        yield from found(top)

    return rows.mapInArrow(run, f"qid {qtype}, {id_col} {itype}, {value} double{', _cv array<double>' if carry else ''}")


def block_join(q: DataFrame, c: DataFrame, make: Callable[[], _TopK], id_col: str, value: str,
               carry: bool = False, cells: int | None = None, query_block: int = QUERY_BLOCK,
               sized: tuple[DataFrame, int] | int | None = None) -> DataFrame:
    """All queries against all corpus rows by cells.  ``q``: (_q, payload...), ``c``: (_i, payload...).

    With many queries (``CELL_QUERIES`` in all cells) the cells are as few as
    hold the corpus in tasks of ``HELD_VALUES`` (one a core at least), for every
    query is sent to every cell and has ``k`` rows from each.  ``sized``: a table with as many rows as
    ``c`` that is cheaper to count, and the values of a row; or the number of all values.
    """
    spark = c.sparkSession
    asked = q.count()
    many = asked > query_block
    n = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not cells and (many or asked * n > CELL_QUERIES):
        if isinstance(sized, int):
            values = sized
        else:
            values = sized[0].count() * sized[1] if sized else c.agg(F.sum(F.size(c.columns[1]).cast("long"))).first()[0] or 0  # one number
        cores = max(spark.sparkContext.defaultParallelism, 1)
        fewest = cores * max(1, -(-values // (HELD_VALUES * cores)))
        n = fewest if many else min(n, fewest)
    side = F.lit(int(many))
    qr = q.withColumns({"_cell": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "_side": side})
    cr = c.withColumns({"_cell": F.pmod(F.xxhash64("_i"), F.lit(n)).cast("int"), "_side": 1 - side})
    return score_cells(qr, cr, make, id_col, value, carry, n, even=True)


def semantic_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine",
                    qid_col: str = "qid", qvec_col: str = "embedding",
                    id_col: str = "chunk_id", vec_col: str = "embedding",
                    carry_vectors: bool = False, cells: int | None = None,
                    query_block: int = QUERY_BLOCK, sized: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``(qid, id, distance, rank)`` — the k nearest corpus rows per query, ascending.

    ``metric``: ``cosine`` (1 - cos), ``l2`` (squared Euclidean, the vector
    store default) or ``ip`` (1 - inner product).  Ties rank by id.
    ``carry_vectors`` adds each hit's own vector (``_cv``) so a re-ranker needs
    no join back to the corpus.  ``cells``: parts of the corpus (default: the
    shuffle partitions).  ``sized``: see ``block_join``.  Vectors of unequal length are an error.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = queries.select(F.col(qid_col).alias("_q"), F.col(qvec_col).cast("array<double>").alias("_v"))
    c = corpus.select(F.col(id_col).alias("_i"), F.col(vec_col).cast("array<double>").alias("_v"))
    cand = block_join(q, c, lambda: _TopK(k, metric, carry_vectors), id_col, "distance", carry_vectors, cells, query_block, sized)
    w = Window.partitionBy("qid").orderBy(F.round("distance", RANK_DECIMALS), F.col(id_col))
    return (cand.withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= k)
                .withColumnRenamed("qid", qid_col))


def likely_hits(rows: DataFrame, ids: DataFrame, id_col: str = "chunk_id", others: bool = False) -> DataFrame:
    """Rows whose id is among ``ids``, and few others: a filter of 2 MB whatever the number of ids, so that the
    exact join with the distinct ids that follows shuffles little of a large table (a semi-join would be pushed below it).
    ``others``: the remaining rows instead, none of which has such an id."""
    at = F.pmod(F.xxhash64(id_col), F.lit(1 << FILTER_BITS)) + 1
    bits = ids.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_b"))
    x = rows.withColumn("_at", at)
    x = x.join(F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_k"), "left" if others else "inner")
    bit = F.expr("shiftright(conv(hex(substring(_b, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10), cast(bitmap_bit_position(_at) % 8 as int)) & 1")
    return x.where(F.coalesce(bit, F.lit(0)) == 0 if others else bit == 1).select(*rows.columns)


def retrieve(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    """D3: the top-k ids without scores."""
    hits = semantic_search(queries, corpus, k, **kw)
    return hits.drop("distance")


# --------------------------------------------------------------------------- D4 MMR

def _mmr_pick(pdf, k: int, lam: float, id_col: str, metric: str):
    """Greedy maximal-marginal-relevance over one query's candidates (<= fetch_k rows)."""
    import pandas as pd

    E = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["_cv"]])
    q = np.asarray(pdf["_qv"].iloc[0], dtype=np.float64)
    en = np.linalg.norm(E, axis=1)
    # of the vectors of an id that comes more than once, a hit's is the one at the hit's distance
    off = np.abs(_distances(E, q[None, :], metric, en, np.linalg.norm(q)[None])[:, 0] - pdf["distance"].to_numpy())
    order = np.lexsort((off, pdf["rank"].to_numpy()))
    order = order[~pdf["rank"].iloc[order].duplicated().to_numpy()]
    pdf, E, en = pdf.iloc[order], E[order], en[order]
    qn = np.linalg.norm(q)
    den = en * qn
    qsim = np.divide(E @ q, den, out=np.zeros(len(E)), where=den > 0)
    pden = en[:, None] * en[None, :]
    pair = np.divide(E @ E.T, pden, out=np.zeros((len(E), len(E))), where=pden > 0)
    first = int(np.lexsort((np.arange(len(E)), -np.round(qsim, RANK_DECIMALS)))[0])
    picked = [first]
    while len(picked) < min(k, len(E)):
        best, best_i = None, -1
        for i in range(len(E)):
            if i in picked:
                continue
            red = max(pair[i, j] for j in picked)
            score = round(lam * qsim[i] - (1.0 - lam) * red, RANK_DECIMALS)
            if best is None or score > best:
                best, best_i = score, i
        picked.append(best_i)
    ids = pdf[id_col].to_numpy()
    return pd.DataFrame({"qid": [pdf["qid"].iloc[0]] * len(picked),
                         id_col: [ids[i] for i in picked],
                         "pick": list(range(1, len(picked) + 1))})


def mmr(queries: DataFrame, corpus: DataFrame, k: int = 4, fetch_k: int = 8, lam: float = 0.5,
        metric: str = "l2", qid_col: str = "qid", qvec_col: str = "embedding",
        id_col: str = "chunk_id", vec_col: str = "embedding",
        fetch: Callable[[DataFrame], DataFrame] | None = None, sized: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Diversity re-rank — fetch ``fetch_k`` nearest, then greedily pick ``k``
    maximising ``lam * sim(q, d) - (1 - lam) * max sim(d, picked)``; the first
    pick is the most similar; ties go to the earlier candidate.

    Each query's group holds at most ``fetch_k`` candidate rows, so the Python
    step works on bounded groups only.  ``fetch`` gives the rows (id, vector) of
    a table of distinct ids where that is cheaper than another pass over ``corpus``.
    """
    shared_dir(queries.sparkSession)
    cand = semantic_search(queries, corpus, fetch_k, metric, qid_col, qvec_col, id_col, vec_col, sized=sized)
    cand = cand.withColumnRenamed(qid_col, "qid").checkpoint()  # ids only; the vectors of the final ones are fetched once
    ids = cand.select(id_col).distinct()
    rows = likely_hits(corpus.select(id_col, vec_col), ids, id_col).join(ids, id_col) if fetch is None else fetch(ids)
    wanted = rows.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("_cv"))
    qv = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("_qv"))
    c = cand.join(wanted.distinct(), id_col).join(qv, "qid").select("qid", id_col, "rank", "distance", "_cv", "_qv")
    kinds = dict(c.dtypes)
    out = c.groupBy("qid").applyInPandas(lambda pdf: _mmr_pick(pdf, k, lam, id_col, metric),
                                         f"qid {kinds['qid']}, {id_col} {kinds[id_col]}, pick int")
    return out.withColumnRenamed("qid", qid_col)


# --------------------------------------------------------------------------- D5 LSH

def ann_search(queries: DataFrame, corpus: DataFrame, k: int, bucket_length: float = 0.1,
               tables: int = 8, seed: int = 7,
               qid_col: str = "qid", qvec_col: str = "embedding",
               id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate k-nearest by Euclidean distance with random-projection LSH.

    Candidates are pairs that share a hash bucket in at least one of
    ``tables`` hash tables (an equi-join on bucket keys, no product, at any
    distance); they are rescored exactly and the best ``k`` per query kept.
    Queries with fewer than ``k`` candidates are answered by the exact search,
    so no list is short.  Neighbours that never collide are missed — that is
    the approximation; measure it with ``recall_at_k``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    c = corpus.select(F.col(id_col).alias("_id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    q = queries.select(F.col(qid_col).alias("_qid"), array_to_vector(F.col(qvec_col).cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(c)
    pairs = model.approxSimilarityJoin(q, c, float("inf"), distCol="distance")
    p = pairs.select(F.col("datasetA._qid").alias(qid_col), F.col("datasetB._id").alias(id_col), "distance")
    w = Window.partitionBy(qid_col).orderBy(F.round("distance", RANK_DECIMALS), F.col(id_col))
    near = p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    full = near.filter(F.col("rank") == k).select(qid_col)
    short = queries.join(full, qid_col, "left_anti")
    exact = semantic_search(short, corpus, k, "l2", qid_col, qvec_col, id_col, vec_col)
    exact = exact.select(qid_col, id_col, F.sqrt("distance").alias("distance"), "rank")
    return near.join(full, qid_col, "left_semi").select(qid_col, id_col, "distance", "rank").unionByName(exact)


def recall_at_k(approx: DataFrame, exact: DataFrame, qid_col: str = "qid", id_col: str = "chunk_id") -> DataFrame:
    """Per query: share of the exact top-k found by the approximate search."""
    hit = exact.join(approx.select(qid_col, id_col, F.lit(1).alias("_f")), [qid_col, id_col], "left")
    return hit.groupBy(qid_col).agg((F.count("_f") / F.count(F.lit(1))).alias("recall"))
