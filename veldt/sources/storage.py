"""Where tables that only live for a while are kept."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where it is
    unset, a private one, but only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"
