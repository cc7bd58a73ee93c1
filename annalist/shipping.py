"""Make this package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless the workers' path has its folder."""
    root = Path(__file__).resolve().parent.parent
    here = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in here or os.path.realpath(os.getcwd()) == str(root):
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="annalist-code-")) / "annalist.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (root / "annalist").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
