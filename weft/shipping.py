"""Making this package importable in Python workers, wherever the session's driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the application once; executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="weft-") as folder:
        path = os.path.join(folder, "weft.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        kept = os.path.join(tempfile.mkdtemp(prefix="weft-ship-"), "weft.zip")
        os.replace(path, kept)
    context.addPyFile(kept)
    _shipped.add(context.applicationId)
