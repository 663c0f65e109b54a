"""The folder that all executors share, for what a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only where all tasks run in the
    driver's own process, as in tests, and none is named, a temporary folder that ends with it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        # Executors would each write to a disk of their own, and what is read back would lack rows.
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = d = tempfile.mkdtemp(prefix="stages-")
        atexit.register(shutil.rmtree, d, True)
    return "file://" + _OWN[sc.applicationId]


def path_of(spark: SparkSession, name: str) -> tuple:
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    name = f"{shared_folder(spark)}/stages-{app}"
    if app not in _MADE:
        path, fs = path_of(spark, name)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MADE.add(app)
    return name
