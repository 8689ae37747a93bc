"""Sends this package's code to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, the whole package as it lies on disk: two archives of one package would hide each other's modules."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quillon-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
