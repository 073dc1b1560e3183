"""Session helpers: one place for the configuration every job relies on.

Nothing here hides Spark: ``get_session`` is a plain builder with the
settings the library assumes (UTC, AQE, Arrow), and ``checkpoint_dir``
resolves the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Each Spark task is already one core; keep BLAS single-threaded inside the
# Arrow scorer so 8 tasks do not each spawn 8 BLAS threads.
_BLAS_ENV = {
    "OPENBLAS_NUM_THREADS": "1",
    "OMP_NUM_THREADS": "1",
    "MKL_NUM_THREADS": "1",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "nearfield",
    extra: dict | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes."""
    for k, v in _BLAS_ENV.items():
        os.environ.setdefault(k, v)
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Checkpoint files of DataFrames that are no longer referenced are removed.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in _BLAS_ENV.items():
        conf[f"spark.executorEnv.{k}"] = v
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        # Local mode: the driver JVM is the executor; only effective at JVM start.
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a session on a
    ``local`` master may leave it unset (tests): a scratch folder is then made
    and registered.  Any other master without the setting is an error, because
    a machine-local folder is not seen by the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="nearfield-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a written table.

    Only the name is made here; the folder appears when Spark's writer commits
    to it, through whatever file system the base path belongs to.
    """
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table through the file system its path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
