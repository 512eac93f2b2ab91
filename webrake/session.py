"""Session helpers.

Jobs never build their own session when one is handed to them; these helpers
are for tests, the benchmark and command-line use.  The checkpoint directory
is read from the session (``spark.checkpoint.dir``); a private one under the
system temp folder is only created when the session has none, which is the
local/test case.  On a cluster, ``spark.checkpoint.dir`` must name a shared
folder (HDFS, S3, ...).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "webrake") -> SparkSession:
    """A local session tuned the way the jobs expect to run on a cluster:
    AQE with partition coalescing and skew-join splitting on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HTML rows are large: keep Arrow batches small for mapInPandas.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tasks_for(df: DataFrame, rows_per_task: int) -> int:
    """Number of tasks that leaves ``rows_per_task`` rows of ``df`` to each (the
    session's parallelism at least).  Adaptive coalescing goes by compressed
    bytes, which tell neither files nor the memory of a sort; ``df`` is counted,
    so it should be a plain scan."""
    return max(-(-df.count() // rows_per_task), df.sparkSession.sparkContext.defaultParallelism)


def text_tasks(df: DataFrame, text: str, bytes_per_task: int) -> int:
    """:func:`tasks_for` by the bytes of a text column, which is read for it."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return max(-(-size // bytes_per_task), df.sparkSession.sparkContext.defaultParallelism)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set a temp one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        # Local runs and tests only: executors of a cluster do not see the
        # driver's disk, so a cluster must name a shared folder.
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="webrake-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote below the checkpoint folder, on
    whatever file system that is; anything else is refused."""
    base = checkpoint_dir(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full, root = (files.makeQualified(p).toString() for p in (target, hadoop.Path(base)))
    if ".." in path.split("/") or not full.startswith(root + "/"):
        raise ValueError(f"{path} does not lie below {base}")
    files.delete(target, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``webrake`` importable in Python workers, as ``--py-files`` does:
    the package's modules are zipped once per application on the driver and
    added with ``addPyFile`` (Spark serves the file to every executor).
    Operators that run Python in tasks (``pandas_udf``, ``mapInPandas``)
    call this; it does nothing when the package is installed."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import webrake
    pkg_dir = os.path.dirname(os.path.abspath(webrake.__file__))
    if "site-packages" not in pkg_dir and "dist-packages" not in pkg_dir:
        root = os.path.dirname(pkg_dir)
        zpath = os.path.join(tempfile.mkdtemp(prefix="webrake-py-"), "webrake.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(zpath)
    _SHIPPED.add(app)
