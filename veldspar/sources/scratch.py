"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; on a local master, below a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
