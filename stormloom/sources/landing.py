"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def landed(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: it is computed once, its lineage ends there, and it outlives executors. The
    folder is the session's spark.checkpoint.dir. Where that is unset, a session within one process makes a new one; a
    cluster is refused, as its executors would write to their own disks."""
    spark = df.sparkSession
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="stormloom-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
