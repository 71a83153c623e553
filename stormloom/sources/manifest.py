"""Benchmark manifests, and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries; scans is 5 and local_only false where they are absent, site ids are upper-cased."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.withColumns({"site_id": F.upper("site_id"), "scans": F.coalesce("scans", F.lit(5)), "local_only": F.coalesce("local_only", F.lit(False))})


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
