"""Sends this package to the executors, for clusters on which it isn't installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip file once per application; Python workers import it from there."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(package)
        folder = tempfile.mkdtemp(prefix=f"{name}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(package, os.path.join(folder, "src", name), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", os.path.join(folder, "src")))
        _sent.add(app)
    return spark
