"""This package on the executors' Python path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the executors, once for each context. Called before each use of Python there."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="graphloom-")  # on the driver, which serves the file for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = Path(folder) / "graphloom_package.zip"
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(_HERE.rglob("*.py")):
            out.write(f, f"{_HERE.name}/{f.relative_to(_HERE)}")
    context.addPyFile(str(at))
    context._graphloom_shipped = True
