"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours wants; sizes are for the 100 TB target, AQE
# shrinks them at runtime for small inputs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ~128 MB per scan split and per post-shuffle partition: fits executor
    # memory for text rows; AQE coalesces small shuffles
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "passagekit",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only in local mode may the session name none (tests); then we set one
    ourselves. On a cluster a machine-local folder would lose rows, so an
    unset folder is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = os.path.join("/tmp", "passagekit-checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_SCRATCH: set = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one job's output.

    Results are read back lazily, so a path lives as long as its application:
    the application's own folder is removed when the driver process ends.
    """
    base = f"{shared_dir(spark)}/passagekit/{spark.sparkContext.applicationId}"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``passagekit`` importable in local Python workers (once per context).

    Only when the shared folder is a local path (local mode, tests): the
    package is zipped there and registered with ``addPyFile``. On a cluster
    (remote shared folder) the package is shipped at submit time
    (``--py-files``) and nothing is written here.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    _SHIPPED.add(key)
    base = shared_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else base
    if "://" in local or not local.startswith("/"):
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(local, "passagekit-dist", uuid.uuid4().hex[:12])
    os.makedirs(out, exist_ok=True)
    archive = shutil.make_archive(os.path.join(out, "passagekit"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="passagekit")
    sc.addPyFile(archive)


def spread(df, min_partitions: int | None = None):
    """Round-robin repartition only when a scan yields fewer partitions than
    the cluster has cores (e.g. a single-row-group file feeding CPU-heavy
    parsing or encoding). Large inputs already have enough splits and pass
    through untouched."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def load(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = True):
    df = table(spark, sf_dir, name)
    return spread(df) if spread_rows else df
