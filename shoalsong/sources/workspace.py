"""Where intermediate tables live."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shoalsong-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's spark.checkpoint.dir.

    A temporary folder of this machine is used only when the setting is absent
    and Spark runs in this one process, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; not created yet."""
    return f"{shared_folder(spark)}/shoalsong/{name}-{uuid.uuid4().hex}"
