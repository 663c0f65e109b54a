"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: workers on this machine get the package's folder on their
    path; for those of a cluster Spark distributes the package as a zip file."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    if not sc.master.startswith("local"):
        # The driver serves this file to executors as long as it runs.
        d = tempfile.mkdtemp(prefix="ship-")
        atexit.register(shutil.rmtree, d, True)
        sc.addPyFile(shutil.make_archive(f"{d}/choralis", "zip", ROOT, "choralis"))
