"""Exact deduplication over an extendible-hash index in shared files. DataFrame operations only.

A text's key is a 64-bit hash. The directory maps the first bits of a key to a bucket; a bucket with too many entries is
split in two by one more bit, and the directory doubles when that bit is a new one. Owner tasks, each for some buckets,
that is ranges of keys, write the index: for each key a chain of entries, one unless texts collide. Where several rows have
a key, their texts go to the owner, which tells them apart by their bytes. A row finds its entry through the directory: by
its bucket, its key and, in a chain, its text's digest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_map, lower_ascii, shared_table, shuffle_partitions, with_mark

#: Entries of a bucket, beyond which it is split; more are allowed where the directory would pass MAX_DEPTH bits, which
#: needs some 5 * 10 ** 8 keys. The directory, 2 ** MAX_DEPTH rows of 16 bytes at most, is broadcast.
CAPACITY = 2048
MAX_DEPTH = 20
#: Rows of a text, at most, that its bucket's owner compares, however many copies it has.
SALTS = 16


def split_buckets(histogram: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int]]:
    """Directory splitting over counts of `depth`-bit prefixes: buckets (prefix, local depth), together covering all keys."""
    totals = [dict(histogram)]
    for _ in range(depth):
        up: dict[int, int] = {}
        for p, c in totals[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + c
        totals.append(up)
    totals.reverse()  # totals[d]: counts of d-bit prefixes
    done, overfull = [], [(0, 0)]
    while overfull:
        prefix, d = overfull.pop()
        if totals[d].get(prefix, 0) > capacity and d < depth:
            overfull += [(2 * prefix + 1, d + 1), (2 * prefix, d + 1)]
        else:
            done.append((prefix, d))
    return done


def build_directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int, int]:
    """(rows of `prefix` and `bucket`, numbered by prefix; global depth; number of buckets) for the column `key` of keys.

    The driver holds counts of at most 2 ** max_depth prefixes, whatever the input's size."""
    n = keys.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(n, 1) / capacity)) + 3))
    capacity = max(capacity, math.ceil(4 * n / 2**max_depth))
    counted = keys.groupBy(first_bits("key", depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    buckets = split_buckets(dict(zip(*(c.to_pylist() for c in counted.columns), strict=True)), depth, capacity)
    top = max(d for _, d in buckets)
    slots = [(q, b) for b, (p, d) in enumerate(sorted(buckets, key=lambda x: x[0] << (top - x[1]))) for q in range(p << (top - d), (p + 1) << (top - d))]
    table = pa.table([pa.array([q for q, _ in slots], pa.int64()), pa.array([b for _, b in slots], pa.int32())], names=["prefix", "bucket"])
    return keys.sparkSession.createDataFrame(table), top, len(buckets)


def first_bits(key: str, depth: int) -> Column:
    return (F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0)).cast("long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lower_ascii, hash_of: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY, carried: list[str] | None = None) -> DataFrame:
    """One row per row of docs: its id, the columns `carried` (default: all), keep_id, group_size (long), kept (boolean),
    text_sha256 (of the normalised text).

    A null text counts as empty. Of equal texts the largest id stays; a null id is less than all others and stays only
    where a group has no other. Rows alike in id and text count in group_size and are all kept or all dropped. Input
    columns named like an output are replaced. No rows in: no rows out.
    """
    outputs = ["keep_id", "group_size", "kept", "text_sha256"]
    names = [c for c in docs.columns if c == id_col or (c not in outputs and (carried is None or c in carried))]
    norm = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    key, sha = hash_of(norm).cast("long"), F.sha2(norm, 256)
    rest = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = shared_table(docs.select(rest.alias("row"), F.col(f"`{id_col}`").alias("id"), key.alias("key"), sha.alias("sha")), "dedup-rows")

    entries = shared_table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("last")), "dedup-entries")
    directory, depth, n_buckets = build_directory(entries, capacity)
    owners = min(n_buckets, 4 * shuffle_partitions(docs.sparkSession))

    def located(df: DataFrame) -> DataFrame:
        """df with the bucket of its key."""
        return df.withColumn("prefix", first_bits("key", depth)).join(F.broadcast(directory), "prefix").drop("prefix")

    # the texts of keys that several rows have; a bit map passes them and few others, which do no harm
    several = with_mark(rows, "key", bit_map(entries.filter("size > 1"), "key")).filter("__marked").select(F.xxhash64("id").alias("at"))
    texts = with_mark(docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("__at"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`")), "__at", bit_map(several, "at")).filter("__marked")
    # copies are added up to SALTS rows of a text at most before its bucket's owner gets them
    copies = texts.select("id", norm.alias("norm"), key.alias("key")).groupBy("key", "norm", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    copies = copies.agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("last")).select("key", "norm", "size", "last", F.lit(False).alias("single"))
    singles = entries.filter("size = 1").select("key", F.lit(None).cast("string").alias("norm"), "size", "last", F.lit(True).alias("single"))

    owned = located(copies.unionByName(singles)).repartition(owners, "bucket")
    owned = owned.groupBy("bucket", "key", "norm", "single").agg(F.sum("size").alias("size"), F.max("last").alias("last"))  # by the bytes, where the owner is
    chain = F.collect_list(F.struct("single", F.sha2("norm", 256).alias("sha"), "size", "last"))
    index = owned.groupBy("bucket", "key").agg(chain.alias("chain"))
    index = shared_table(index.sortWithinPartitions("bucket", "key"), "dedup-index").withColumnsRenamed({"bucket": "i_bucket", "key": "i_key"})

    found = located(rows).join(index, (F.col("bucket") == F.col("i_bucket")) & (F.col("key") == F.col("i_key")))
    own = F.filter("chain", lambda c: c["single"] | (c["sha"] == F.col("sha")))
    found = found.withColumn("own", F.get(own, F.lit(0))).filter("own IS NOT NULL").withColumns({"e_size": F.col("own.size"), "e_last": F.col("own.last")})
    kept = F.col("id").eqNullSafe(F.col("e_last"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("e_last").alias("keep_id"), F.col("e_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
