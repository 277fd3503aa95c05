"""Sends the package to the executors' Python workers where they wouldn't find it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; not if the package's folder is on PYTHONPATH or the working folder, which workers share."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if app in _done or root in known:
        return
    path = Path(tempfile.mkdtemp()) / "tallyspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "tallyspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)


def shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
