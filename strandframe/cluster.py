"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_strandframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strandframe-")) / "strandframe.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"strandframe/{file.relative_to(root)}")
    context.addPyFile(str(path))
    context._strandframe_shipped = True
