"""Make the package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the workers of this application, as ``--py-files`` would; once only."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Spark takes it from the driver and hands it to every executor
    path = os.path.join(tempfile.mkdtemp(prefix="moodfeed-"), "moodfeed_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    # texts are long: batches of fewer rows bound the memory of a task on both sides
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    _shipped.add(context.applicationId)
