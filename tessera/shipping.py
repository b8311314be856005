"""Python workers on other machines need this package: the driver sends it once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="code-")  # the driver serves the archive while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    source = Path(folder, "source", package.name)
    shutil.copytree(package, source, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}_code", "zip", source.parent))
    _shipped.add(app)
