"""Session set-up and the one way in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to a Python worker that receives whole texts.
TEXT_BATCH_ROWS = 512


def session(cores: str = "*", app: str = "siftline", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's own session is used instead."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        found = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each application, so that they need no path of the driver's."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siftline-code-")  # code that Spark itself copies to the executors, no data
    archive = os.path.join(folder, "siftline.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder as parquet and read back.

    It survives the loss of executors, is compressed and column-pruned by later reads, and holds nothing in executor
    memory. Used where a result is read more than once or where an iteration would otherwise grow its lineage.
    """
    spark = df.sparkSession
    shipped(spark)
    folder = os.path.join(shared_folder(spark), f"siftline-{spark.sparkContext.applicationId}")
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_removed, spark, folder)
    path = os.path.join(folder, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDERS: set[str] = set()


def _removed(spark: SparkSession, folder: str) -> None:
    """Deletes what this application stored, when its driver ends; what a killed one leaves is named by its id."""
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_PREPARED: dict[tuple, DataFrame] = {}


def version(spark: SparkSession, folder: str) -> tuple:
    """The version of the tables of a folder: name, length and time of each file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def prepared(spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table of the index, built from the tables of a folder once for each version of them, then read from the shared
    folder: what a search reads is prepared by the build, as are postings and profiles."""
    key = (spark.sparkContext.applicationId, folder, name, version(spark, folder))
    if key not in _PREPARED:
        _PREPARED[key] = stored(build(spark, folder))
    return _PREPARED[key]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a table that is spread over all cores where it comes in fewer files than there are cores.
SMALL_TABLE = 64 << 20


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows take long to work on. A small one in a few files would keep only so many cores busy, so it is
    dealt out to all of them; larger tables are read as they lie, without a shuffle."""
    rows = table(spark, folder, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if size.getFileCount() < cores and size.getLength() < SMALL_TABLE else rows
