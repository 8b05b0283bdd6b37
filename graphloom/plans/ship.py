"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(Path("graphloom") / file.relative_to(root)))
    context.addPyFile(target)  # served by the driver to all executors
    context._graphloom_shipped = True
