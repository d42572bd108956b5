"""Shipping this package to a cluster's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of one Arrow batch: texts can be long, and what a Python worker holds is a multiple of its batch.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, before a Python function of it runs there, and bound the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="lexispark-"), "lexispark_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "lexispark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
