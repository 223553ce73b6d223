"""Makes the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows in one Arrow batch to Python: texts can be long, and a worker holds a batch or two.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once an application (Spark's own file server carries it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as folder:
            tree = shutil.copytree(package, os.path.join(folder, "tree", "lodestrata"), ignore=shutil.ignore_patterns("__pycache__"))
            kept = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata")
            spark.sparkContext.addPyFile(shutil.make_archive(kept, "zip", os.path.dirname(tree), "lodestrata"))
        _shipped.add(app)
    return spark
