"""Sends this package to the executors, whose Python workers may not find it otherwise."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package as a zip file, fetched by each executor from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
    _sent.add(sc.applicationId)
