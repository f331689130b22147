"""Fresh paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quillframe.errors import InvalidArgument


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where neither the session nor the context has one, a temporary folder is
    set, but only on one machine: executors elsewhere could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not context.master.startswith("local"):
        raise InvalidArgument("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillframe-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/quillframe/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete the library's scratch tables; frames and results that still read them must have been written by then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/quillframe")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
