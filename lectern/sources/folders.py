"""Folders that the driver and all executors share, for what is written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir.

    Where the setting is absent (tests in one JVM), a temporary folder takes its
    place; on any other master that would not be shared, so it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(context, "_lectern_dir", None) or tempfile.mkdtemp(prefix="lectern-")
        context._lectern_dir = base
    return f"{base.rstrip('/')}/lectern-{label}-{uuid.uuid4().hex}"
