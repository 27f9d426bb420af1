"""Make this package importable on executors, however the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows that go to a Python worker at once. Texts are long, and a batch stands in memory several times.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors through Spark's file server, once per application, and keep Arrow batches small where the session has Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="knowloom-code-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "knowloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(d, name)
                        z.write(full, os.path.join("knowloom", os.path.relpath(full, top)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
