"""Brings this package to the executors' Python, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure(spark: SparkSession) -> SparkSession:
    """Send the package's sources along with the application, once; workers that can import them anyway don't mind."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(), "terraspan_sources.zip")
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, f"terraspan/{source.relative_to(root)}")
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
