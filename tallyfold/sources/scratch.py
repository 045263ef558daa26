"""Intermediate results in the folder that all executors share, and this package's modules on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder is made only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyfold-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut.

    The files go with the session's context cleaner where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, for functions that run in Python there."""
    context = spark.sparkContext
    if getattr(context, "_tallyfold_shipped", False):
        return
    package = Path(__file__).parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tallyfold-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in package.rglob("*.py"):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tallyfold_shipped = True
