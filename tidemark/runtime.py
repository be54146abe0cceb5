"""What Python workers need from the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that functions run there find it."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemark-")  # served to the executors as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("tidemark", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, gone with
    the driver: a local one if there is one machine only, else one in the warehouse, which all machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = getattr(context, "_tidemark_dir", None)
    if not found:
        if context.master.startswith("local[") or context.master == "local":
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = f"file://{folder}"
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        context._tidemark_dir = found
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, with its partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
