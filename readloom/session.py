"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_scratch: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python workers import the functions that they run; a cluster's workers
    do not see the driver's folders, so the package goes along as a zip file.
    """
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="readloom-"), "readloom_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("readloom", os.path.relpath(full, _ROOT)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def _bytes(text: str) -> int:
    """A size setting in bytes; 0 if it has a unit, which is then set anew."""
    text = text.strip().lower().removesuffix("b")
    return int(text) if text.lstrip("-").isdigit() else 0


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch, as texts may be long.

    A batch of Spark's default of 10,000 rows lies in memory several times, in
    the JVM and in Python. Settings that a user made smaller stay.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = _bytes(spark.conf.get(name))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > 4096:
        spark.conf.set(name, "4096")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only
    where that is unset and all runs on one machine, as in tests, a local folder
    is used; on a cluster a missing setting raises.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return str(jvm_dir.get())
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="readloom-shared-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; it goes when the driver ends, or with clean()."""
    top = f"{shared_dir(spark).rstrip('/')}/readloom-{spark.sparkContext.applicationId}"
    if top not in _scratch:
        _scratch[top] = spark
        atexit.register(clean, spark)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; results not yet read need it."""
    for top in [x for x, own in _scratch.items() if own is spark]:
        # The JVM may be gone already when the driver ends.
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            del _scratch[top]


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cut off, and of a size that the planner knows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
