"""D5 as a stored index that prunes: an inverted file of coarse cells.

``build_ivf`` fits k-means centres on a bounded sample (``SAMPLE_ROWS`` rows of
smallest id hash), assigns every row to its nearest centre and writes the rows
partitioned by cell, hot cells over several files.  ``cells`` holds a row per
cell: centre, number of rows and radius (largest distance of a row to its centre).

``ivf_search`` scans a query's ``probes`` nearest cells and scores their rows
exactly.  With ``exact`` it then scans every further cell that may hold a
nearer row than the k-th found: a row of a cell is not nearer to the query than
the centre's distance less the radius.  Only the probed cells' folders are read.

For cosine the vectors are normalised, so that ``1 - cos`` is half the squared
Euclidean distance; zero vectors have distance 1 to everything and are kept.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package
from .retrieval import QUERY_BLOCK, RANK_DECIMALS, _TopK, _vectors, score_cells

SAMPLE_ROWS = 20_000     # rows that the centres are fitted on
CELL_LIMIT = 4096        # cells of an index at most: what is collected and sent to tasks
CELL_ROWS = 100_000      # rows of a cell that one task scores; larger cells are split
METRICS = ("cosine", "l2")


class IvfIndex(NamedTuple):
    rows: DataFrame      # cell, id, embedding
    cells: DataFrame     # cell, centre, n, radius
    metric: str


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return v
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _away(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows x centres Euclidean distances."""
    sq = (v * v).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * v @ centres.T
    return np.sqrt(np.maximum(sq, 0.0))


def train_cells(corpus: DataFrame, n_cells: int, metric: str, id_col: str, vec_col: str, seed: int = 17, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres (at most ``n_cells`` x dim) by k-means on the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = corpus.select(id_col, vec_col).where(F.size(vec_col) > 0).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    sample = sample.select(F.col(vec_col).cast("array<double>").alias("a")).distinct().cache()
    n_cells = min(n_cells, sample.count())
    if n_cells < 2:
        return _unit(np.array([sample.first()["a"]]), metric)
    sample = sample.select(array_to_vector("a").alias("v"))
    if metric == "cosine":
        from pyspark.ml.feature import Normalizer
        sample = Normalizer(inputCol="v", outputCol="u").transform(sample).select(F.col("u").alias("v"))
    model = KMeans(k=n_cells, seed=seed, maxIter=10, initMode="random", featuresCol="v").fit(sample)
    return np.array([c.tolist() for c in model.clusterCenters()])


def build_ivf(corpus: DataFrame, path: str, n_cells: int = 64, metric: str = "l2", id_col: str = "chunk_id", vec_col: str = "embedding",
              seed: int = 17, sample_rows: int = SAMPLE_ROWS) -> IvfIndex:
    """Write the index of all rows of ``corpus`` under ``path``; rows without a vector are left out."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if not 2 <= n_cells <= CELL_LIMIT:
        raise ValueError(f"2 to {CELL_LIMIT} cells")
    spark = corpus.sparkSession
    ship_package(spark)
    src = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    if src.isEmpty():
        empty = src.select("id", "embedding", F.lit(0.0).alias("away"), F.lit(0).alias("cell"))
        empty.write.mode("overwrite").parquet(f"{path}/rows")  # without folders, so that the schema is written
        centres = np.zeros((1, 1))
    else:
        centres = train_cells(src, n_cells, metric, "id", "embedding", seed, sample_rows)
        bc = spark.sparkContext.broadcast(centres)  # CELL_LIMIT x dim at most

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                if rb.num_rows:
                    d = _away(_unit(_vectors(rb.column(1), bc.value.shape[1]), metric), bc.value)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(d[np.arange(len(d)), cell]), pa.array(cell.astype(np.int32))],
                                                     names=["id", "embedding", "away", "cell"])

        kind = src.schema["id"].dataType.simpleString()
        assigned = src.mapInArrow(assign, f"id {kind}, embedding array<double>, away double, cell int")
        assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    named = spark.createDataFrame([(i, c.tolist(), metric) for i, c in enumerate(centres)], "cell int, centre array<double>, metric string")
    stats.join(F.broadcast(named), "cell").write.mode("overwrite").parquet(f"{path}/cells")
    return load_ivf(spark, path)


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    cells = spark.read.parquet(f"{path}/cells")
    metric = cells.select("metric").first()
    return IvfIndex(spark.read.parquet(f"{path}/rows"), cells, metric["metric"] if metric else METRICS[0])


def _probe(queries: DataFrame, cells: list, metric: str, probes: int, further: bool) -> DataFrame:
    """``(_q, _v, cell)`` of the cells to scan: each query's ``probes`` nearest or, ``further``, the others that may hold
    a row within the query's ``_reach`` (the distance to its k-th hit so far; null: any)."""
    spark = queries.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast((np.array([r["centre"] for r in cells]), np.array([r["cell"] for r in cells], np.int32),
                                       np.array([r["radius"] for r in cells])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, names, radius = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            d = _away(_unit(_vectors(rb.column(1), centres.shape[1]), metric), centres)
            near = np.argsort(d, axis=1, kind="stable")[:, :probes]
            mine = np.zeros(d.shape, bool)
            np.put_along_axis(mine, near, True, axis=1)
            if further:
                reach = np.asarray(rb.column(2).fill_null(float("inf")))
                mine = ~mine & (d - radius[None, :] <= reach[:, None] + 1e-6)
            q, c = np.nonzero(mine)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(q)), rb.column(1).take(pa.array(q)), pa.array(names[c])], names=["_q", "_v", "cell"])

    return queries.mapInArrow(run, f"_q {queries.schema['_q'].dataType.simpleString()}, _v array<double>, cell int")


def _scan(index: IvfIndex, cells: list, pairs: DataFrame, k: int, id_col: str) -> DataFrame:
    """Each query's k nearest rows of the cells it is paired with: only these cells' folders are read."""
    spark = pairs.sparkSession
    pairs = pairs.checkpoint()
    load = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}  # at most CELL_LIMIT numbers
    parts = [(r["cell"], -(-r["n"] // CELL_ROWS), -(-load[r["cell"]] // QUERY_BLOCK)) for r in cells if r["cell"] in load]
    split = F.broadcast(spark.createDataFrame(parts, "cell int, _rows long, _blocks long"))
    side, cell = F.lit(0).alias("_side"), (F.xxhash64("cell", "_p", "_b")).alias("_cell")  # a part of a cell with a block of queries
    block = F.pmod(F.xxhash64("_q"), F.col("_blocks")).alias("_b")
    qr = pairs.join(split, "cell").select("cell", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)).alias("_p"), "_q", "_v").select(cell, side, "_q", "_v")
    rows = index.rows.where(F.col("cell").isin(list(load))).join(split, "cell")
    part = F.pmod(F.xxhash64("id"), F.col("_rows")).alias("_p")
    cr = rows.select("cell", part, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_b"), F.col("id").alias("_i"), F.col("embedding").alias("_v"))
    cr = cr.select(cell, F.lit(1).alias("_side"), "_i", "_v")
    n, metric = int(spark.conf.get("spark.sql.shuffle.partitions")), index.metric
    return score_cells(qr, cr, lambda: _TopK(k, metric, False), id_col, "distance", False, n)


def _top(hits: DataFrame, k: int, id_col: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("distance", RANK_DECIMALS), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ivf_search(index: IvfIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, qid_col: str = "qid", qvec_col: str = "embedding",
               id_col: str = "chunk_id") -> DataFrame:
    """``(qid, id, distance, rank)`` from the cells nearest to each query; ``exact``: the same rows as ``semantic_search``.

    Distances are those of ``semantic_search`` (``1 - cos`` or squared L2).
    Without ``exact`` a list may miss rows of cells that were not probed, and
    be short if the probed cells hold fewer than k rows.
    """
    shared_dir(index.rows.sparkSession)
    cells = index.cells.collect()  # at most CELL_LIMIT rows
    q = queries.select(F.col(qid_col).alias("_q"), F.col(qvec_col).cast("array<double>").alias("_v"))
    if not cells:  # an empty index
        none = index.rows.where("false").select(F.col("id").alias(id_col), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return q.where("false").select(F.col("_q").alias(qid_col)).join(none, F.lit(True))
    first = _top(_scan(index, cells, _probe(q, cells, index.metric, probes, False), k, id_col), k, id_col)
    if not exact:
        return first.withColumnRenamed("qid", qid_col)
    first = first.checkpoint()
    euclid = F.sqrt(F.greatest(F.col("distance") * (2.0 if index.metric == "cosine" else 1.0), F.lit(0.0)))
    reach = first.where(F.col("rank") == k).select(F.col("qid").alias("_q"), euclid.alias("_reach"))
    more = _probe(q.join(reach, "_q", "left").select("_q", "_v", "_reach"), cells, index.metric, probes, True)
    hits = first.drop("rank").unionByName(_scan(index, cells, more, k, id_col))
    return _top(hits, k, id_col).withColumnRenamed("qid", qid_col)
