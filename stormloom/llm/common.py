"""Helpers that the training-data operators share: session settings, shared tables, column functions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_STATE: list[tuple[tuple, object]] = []


def release_memory() -> None:
    """Give memory that Arrow's and C's allocators hold for later back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(key: tuple, make: Callable[[], T]) -> T:
    """What make() gives, kept by this worker process until something else is asked for: one operator's at a time."""
    if not _STATE or _STATE[0][0] != key:
        _STATE.clear()
        release_memory()
        _STATE.append((key, make()))
    return _STATE[0][1]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is named, a session within one
    process gets a new one; a cluster is refused, as its executors would write to their own disks."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="stormloom-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the largest bit map: 2 MB of bits, a broadcast table of at most 262,144 rows.
MAP_BITS = 1 << 24


def bit_map(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(rows of `__word` and `__bits`, number of bits) that mark the places of a column of hashes. It is as large as the
    number of keys asks for, and MAP_BITS at most, whatever their number."""
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(12, math.ceil(math.log2(64 * max(1, keys.count())))))
    marks = keys.select(F.shiftright(F.pmod(F.col(key), F.lit(bits)), 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod({key}, {bits}) % 64 AS int))").alias("__bit"))
    return shared_table(marks.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")), "bit-map"), bits


def with_mark(df: DataFrame, key: str, marks: tuple[DataFrame, int]) -> DataFrame:
    """df with `__marked`: true on all rows whose key is among those of the bit map, and on few others."""
    table, bits = marks
    word, bit = F.shiftright(F.pmod(F.col(key), F.lit(bits)), 6), F.expr(f"shiftleft(1L, cast(pmod({key}, {bits}) % 64 AS int))")
    return df.join(F.broadcast(table), word == F.col("__word"), "left").withColumn("__marked", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")
