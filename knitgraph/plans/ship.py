"""Makes this package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import knitgraph

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, as a zip that Spark distributes."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = os.path.dirname(os.path.abspath(knitgraph.__file__))
    name = os.path.join(tempfile.mkdtemp(), "knitgraph-package")
    context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(folder), os.path.basename(folder)))
    _shipped.add(context.applicationId)
