"""Sends the package to the Python workers of a session that was started without it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        clean = Path(tmp, "src", here.name)
        shutil.copytree(here, clean, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        keep = Path(tempfile.mkdtemp(prefix="ship-"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(keep / here.name), "zip", clean.parent))
    _SHIPPED.add(app)
