"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "gleanframe") -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from outside."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent on a single machine (tests) a temporary folder is made; on a
    cluster no other folder is known to be shared, so its absence is an error.
    """
    found = spark.conf.get(SHARED_DIR_CONF, None) or spark.sparkContext.getConf().get(SHARED_DIR_CONF)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError(f"{SHARED_DIR_CONF} names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="gleanframe-")
        spark.conf.set(SHARED_DIR_CONF, found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table in the shared folder.

    Results read such tables lazily, so they stand until the session's file system is closed at the
    end of the application, which deletes them.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    fs.delete(jpath, True)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate table through Hadoop's file system, wherever it lies."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def estimated_bytes(df) -> int:
    """The size of ``df`` as the planner estimates it from its files; no job runs. 0 where it has no idea (it then names a huge number)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per session.

    Functions of the package reach the workers by name; where the executors do not have the
    repository on their path, Spark's own file server brings it.
    """
    if spark.conf.get("spark.gleanframe.shipped", "no") == spark.sparkContext.applicationId:
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gleanframe-ship-")  # on the driver only; its file server hands the archive out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/gleanframe", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.gleanframe.shipped", spark.sparkContext.applicationId)
