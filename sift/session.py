"""SparkSession construction and shared-folder helpers.

Everything here is ordinary session configuration: AQE on (runtime
coalescing and skew-join splitting), UTC session time, Arrow for the few
Python stages, and the UI off.  On a cluster the session is supplied by the
caller; ``build_session`` is for tests, the bench and local use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str | None = None, app: str = "sift",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster names it; we only read it.  When it is unset in a local run
    (one machine, as in tests) a private folder under the system temp dir is set
    once for this session, and ``SparkContext.setCheckpointDir`` follows it so
    ``DataFrame.checkpoint()`` writes there too.  On a cluster a machine-local
    folder would be lost to the executors, so the setting is required there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def drop_path(spark: SparkSession, path: str, result: DataFrame | None = None) -> DataFrame | None:
    """Delete a written intermediate; ``result``, a small one that still reads it, is checkpointed first and returned."""
    shared_dir(spark)
    kept = None if result is None else result.checkpoint()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return kept


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sift`` importable in Python workers (``addPyFile`` of a zip, once per context).

    Only the operators with a Python stage (mapInArrow / applyInPandas) need it;
    the zip is built from the installed package and shipped by Spark itself.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="sift-pkg-"), "sift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith((".py", ".txt")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
