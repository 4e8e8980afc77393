"""Python workers must find this package: it is sent to them where it isn't installed on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's files, once per SparkContext. A no-op for work without Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_threadloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "threadloom-sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(path)
    sc._threadloom_shipped = True
