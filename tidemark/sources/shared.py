"""Where a query may write: the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
ONE_MACHINE = "file:///tmp/checkpoints/tidemark"


def fresh(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or ONE_MACHINE).rstrip('/')}/{name}-{uuid.uuid4().hex}"
