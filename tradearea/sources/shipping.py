"""Makes this package importable on the workers of a cluster that share no folder with the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def package_zip(target: str) -> str:
    """All Python files of the package in one archive."""
    root = os.path.dirname(PACKAGE)
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    return target


def ship(spark: SparkSession) -> None:
    """Hand the package to the application's workers, once per application.

    Spark's own file distribution carries it, so workers need neither a shared folder nor PYTHONPATH.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="tradearea-package-")
        context.addPyFile(package_zip(os.path.join(folder, f"tradearea-{context.applicationId}.zip")))
        _SHIPPED.add(context.applicationId)
