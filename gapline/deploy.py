"""Sending the package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python files of the session's workers, once for each Spark context."""
    context = spark.sparkContext
    if context in _sent:
        return
    here = Path(__file__).resolve().parent
    if here.suffix == ".zip" or not here.is_dir():  # it runs from an archive already
        return
    folder = tempfile.mkdtemp()  # of the driver alone; Spark sends the archive to the workers
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{here.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(here.rglob("*.py")):
            file.write(path, path.relative_to(here.parent))
    context.addPyFile(archive)
    _sent.add(context)
