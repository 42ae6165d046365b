"""Sends this package to Python workers that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once for each context; nothing to do where PYTHONPATH names the package's folder for driver and workers alike."""
    sc = spark.sparkContext
    if str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_graphloom_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._graphloom_sent = True
