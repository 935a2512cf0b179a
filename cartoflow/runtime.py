"""What every part of the library needs from the running session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch handed to a Python task, where the session has only Spark's own bound of 64 MB.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it there.

    Also bounds Arrow batches by bytes: by rows alone a batch of long texts has no bound.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) in ("67108864b", "64MB"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cartoflow-"), "cartoflow.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
