"""Send this package to the executors, for sessions whose Python workers cannot import it by themselves."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the session's context, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        stage = Path(folder, "stage")
        shutil.copytree(package, stage / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="lodestone-"), package.name)), "zip", stage)
    spark.sparkContext.addPyFile(archive)
