"""Where intermediate files go: a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir; it goes when the application ends.

    A local session without that setting uses a temporary folder, a cluster session is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kinosift-files-")
        root = _LOCAL[context.applicationId]
    path = f"{root.rstrip('/')}/kinosift/{tag}-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
