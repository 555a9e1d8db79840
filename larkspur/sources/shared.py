"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a temporary folder in local mode, and else an error: executors would not see it."""
    conf = spark.sparkContext.getConf()
    got = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return _own[0]
