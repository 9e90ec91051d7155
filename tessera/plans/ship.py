"""Sending this package to a cluster's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_HOME = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Make the package importable in the session's workers, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((_HOME / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(_HOME))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True


def shipped(query):
    """A query (spark, sf_dir) that ships the package first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
