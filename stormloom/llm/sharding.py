"""Two-pass external shuffle of records into shards of equal row counts.

The first pass scatters the records with a seeded hash over buckets that fit into a task's memory; the exchange's
files are the buckets. The second pass permutes each bucket by a seeded Fisher-Yates shuffle. The order of all records
is the buckets one after another, so a record's rank is its bucket's offset plus its place there, and a shard is an
equal share of the ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table, shuffle_partitions

SEED = 20240
#: Bytes of records that one bucket should hold; a task keeps one bucket in memory.
BUCKET_BYTES = 64 << 20
#: At least so many buckets for each shuffle partition, so that partitions are alike.
BUCKETS_PER_PARTITION = 4
#: A bucket is too full at so many times the average and so many rows; half of that makes a record a hot one.
HOT_BUCKETS, HOT_ROWS = 3, 1000


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of range(n)."""
    out = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, d in enumerate(draws):
        j = i + d
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def external_shuffle(records: DataFrame, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, size: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """records with `shard` (int) and `slot` (long, gapless from 0 in each shard); shards differ by one row at most.

    size: a column of bytes; by default the strings' lengths plus 8 for every other column. keys: the columns whose
    values name a record (default: all but maps). Nulls in any column are values like others. Rows alike in all keys
    are interchangeable; where they fill a bucket they are scattered one by one. Columns of the input named shard or slot are replaced. No rows in: no rows out. The driver
    holds one offset for each bucket, that is 8 bytes for each `bucket_bytes` of input.
    """
    records = records.drop("shard", "slot", "__bucket", "__hash")
    kinds = {f.name: f.dataType for f in records.schema.fields}
    keys = keys or [c for c, k in kinds.items() if not isinstance(k, T.MapType)]
    width = F.col(f"`{size}`") if size else sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if isinstance(k, T.StringType) else F.lit(8) for c, k in kinds.items()), F.lit(0))
    total = records.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]
    n_buckets = max(math.ceil(total / bucket_bytes), BUCKETS_PER_PARTITION * shuffle_partitions(records.sparkSession))
    scattered = records.withColumn("__hash", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keys])).withColumn("__bucket", F.pmod("__hash", F.lit(n_buckets)).cast("int"))

    def counted(df: DataFrame) -> np.ndarray:
        counts = np.zeros(n_buckets, np.int64)
        for row in df.groupBy("__bucket").count().toLocalIterator():
            counts[row[0]] = row[1]
        return counts

    counts = counted(scattered)
    full = int(counts.sum()) * HOT_BUCKETS // n_buckets + HOT_ROWS
    if counts.max(initial=0) > full:  # at most n_buckets / HOT_BUCKETS such keys
        hot = scattered.groupBy("__hash").count().filter(F.col("count") > full // 2).select(F.col("__hash").alias("__hot"))
        each = F.pmod(F.xxhash64(F.lit(seed), "__hash", F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int")
        spread = scattered.join(F.broadcast(hot), F.col("__hash") == F.col("__hot"), "left")
        scattered = shared_table(spread.withColumn("__bucket", F.when(F.col("__hot").isNull(), F.col("__bucket")).otherwise(each)).drop("__hot"), "scattered")
        counts = counted(scattered)
    n, offsets = int(counts.sum()), np.concatenate([[0], np.cumsum(counts)])
    names = list(kinds)
    schema = T.StructType([*records.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    order = [("__hash", "ascending"), *[(c, "ascending") for c, k in kinds.items() if isinstance(k, (T.NumericType, T.StringType))]]

    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        b = key[0].as_py()
        bucket = bucket.sort_by(order)  # arrival order differs between runs
        at = fisher_yates(bucket.num_rows, (seed, b))
        rank = offsets[b] + np.arange(bucket.num_rows, dtype=np.int64)
        shard = rank * n_shards // n
        first = -(-shard * n // n_shards)
        return bucket.take(pa.array(at)).select(names).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(rank - first))

    return scattered.groupBy("__bucket").applyInArrow(shuffle, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder `shard=k` for each shard. A bucket's ranks are consecutive, so a task writes into one or two shards."""
    shuffled.write.partitionBy("shard").parquet(path)
