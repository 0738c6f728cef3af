"""This package on the executors, for functions that run there."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once for each Spark context."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_macrotide_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-macrotide-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for module in root.rglob("*.py"):
            z.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._macrotide_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names for all executors; a local one only in local mode without one, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-macrotide-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df):
    """``df`` checkpointed, which cuts its lineage; a folder of its own only in local mode without one, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-macrotide-"))
    return df.checkpoint()
