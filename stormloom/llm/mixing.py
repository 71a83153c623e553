"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is wanted t / s times. The whole part of that is certain; the
fraction is rounded so that the words taken come out at the target: two documents pass probability to each other,
weighted by their sizes and in a random direction, until one of them is settled. Each task rounds its own share of the
documents, which leaves one unsettled document per source at most; these residuals are paired again, many tasks' to a
group, level by level up a reduction tree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, shared_table, shuffle_partitions

SEED = 77
MAX_COPIES = 3.0
#: Documents in a leaf of the reduction tree, and leaves (or groups) that one group of the next level combines.
LEAF_ROWS = 20_000
#: Rows alike that are dealt out at a time.
COPIES = 1000
FAN_IN = 64
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size long, target double) for rows of `source` and `size`. Sources in code-point order, null
    last, weigh 1, 2, 3, repeating. A target stops at max_copies times its source's size; the excess is shared anew by
    weight. The window has one row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = sums.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    full = ranked.withColumn("cap", max_copies * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everyone = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = full.withColumns({
        "total": F.sum("source_size").over(everyone).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(rest),
    })
    shares = shares.withColumn("share", (F.col("total") - F.col("capped")) / F.col("weights"))
    # the first source, by level, that the share of the remaining ones doesn't fill sets that share for all after it
    final = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "share"))).over(everyone)
    return shares.withColumn("final", final["share"]).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).alias("target"))


def pivot(sizes: list[int], fractions: list[float], rng: np.random.Generator) -> tuple[list[int], int]:
    """Settle all but one: (0 or 1 for each, -1 for the one left open), its place or -1. sum(size * fraction) is kept
    while two are open. fractions is changed in place."""
    out, open_at = [-1] * len(sizes), -1
    draws = rng.random(2 * len(sizes) + 1).tolist()
    for i, p in enumerate(fractions):
        if p <= 0.0 or p >= 1.0:
            out[i] = int(p >= 1.0)
            continue
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        a, b, pa_, pb = sizes[j], sizes[i], fractions[j], p
        up = min((1 - pa_) * a, pb * b)  # words that may pass from i to j
        down = min(pa_ * a, (1 - pb) * b)  # and from j to i
        if draws[i] * (up + down) < down:
            pa_, pb = (1.0 if up == (1 - pa_) * a else pa_ + up / a), (0.0 if up == pb * b else pb - up / b)
        else:
            pa_, pb = (0.0 if down == pa_ * a else pa_ - down / a), (1.0 if down == (1 - pb) * b else pb + down / b)
        fractions[j], fractions[i], open_at = pa_, pb, -1
        for k, q in ((j, pa_), (i, pb)):
            if 1e-12 < q < 1 - 1e-12:
                open_at = k
            else:
                out[k] = int(q > 0.5)
    return out, open_at


def _settle(seed: int, level: int, last: bool):
    """Rounds one group of rows (any number of sources); the last level draws for what stays open."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("source", "ascending"), ("tie", "ascending"), ("id", "ascending"), ("size", "ascending")])
        source, size, frac = (rows.column(c).to_pylist() for c in ("source", "size", "fraction"))
        settled, rest = [0] * len(size), list(frac)
        rng = np.random.Generator(np.random.PCG64((seed, level, key[0].as_py())))
        start = 0
        while start < len(size):
            end = start
            while end < len(size) and source[end] == source[start]:
                end += 1
            part = rest[start:end]
            out, at = pivot(size[start:end], part, rng)
            if at >= 0 and last:
                out[at] = int(rng.random() < part[at])
            settled[start:end], rest[start:end] = out, part
            start = end
        return rows.set_column(rows.column_names.index("fraction"), "fraction", pa.array(rest, pa.float64())).append_column("extra", pa.array(settled, pa.int32()))

    return run


def apart(sized: DataFrame) -> DataFrame:
    """sized with `copy`, which numbers rows alike from 0. They are counted first, then dealt out again, some at a time, so no
    task holds all rows of a kind."""
    names = sized.columns
    counted = sized.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    some = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    some = some.repartition(shuffle_partitions(sized.sparkSession), "tie", "part")
    end = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    return some.select(*names, F.explode(F.sequence(F.col("part") * COPIES, end)).alias("copy"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, seed: int = SEED, max_copies: float = MAX_COPIES, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target (its source's), copies (int), taken (copies * size).

    The rounding of a document depends on the seed and the data only, so reruns agree. size: words by default; a null
    text has size 0. A document of size 0 gets the whole part of its wanted copies (and takes nothing). Null sources
    are one source. Rows alike in id and text are rounded one by one. A source's taken words differ from its target by
    less than its largest document. No rows in: no rows out.
    """
    spark = docs.sparkSession
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    sized = shared_table(apart(docs.select(id_.alias("id"), source.cast("string").alias("source"), (n_words(text) if size is None else F.coalesce(size, F.lit(0))).cast("long").alias("size"), F.xxhash64(F.lit(seed), id_, text).alias("tie"))), "mix-sizes")
    targets = shared_table(source_targets(sized, max_copies), "mix-targets").withColumnRenamed("source", "t_source")
    small = targets.count() <= BROADCAST_SOURCES
    wanted = sized.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_copies))).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("wanted", copies).withColumn("base", F.floor("wanted").cast("int"))
    fraction = F.when(F.col("size") > 0, F.col("wanted") - F.col("base")).otherwise(F.lit(0.0))
    leaves = max(4 * shuffle_partitions(spark), math.ceil(sized.count() / leaf_rows))
    rows = wanted.withColumn("fraction", fraction).withColumn("leaf", F.pmod(F.xxhash64("tie", "copy"), F.lit(leaves)).cast("long")).drop("wanted", "copy")
    settled, open_, level = [], rows, 0
    names = ["id", "source", "size", "source_size", "target", "base", "fraction", "leaf", "tie"]
    schema = "id {id}, source string, size long, source_size long, target double, base int, fraction double, leaf long, tie long, extra int".format(id=docs.schema[id_col].dataType.simpleString())
    while True:
        out = shared_table(open_.select(names).groupBy("leaf").applyInArrow(_settle(seed, level, leaves == 1), schema), f"mix-level-{level}")
        settled.append(out.filter("extra >= 0"))
        if leaves == 1:
            break
        leaves, level = math.ceil(leaves / fan_in), level + 1
        open_ = out.filter("extra < 0").drop("extra").withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("long"))
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    n = F.col("base") + F.col("extra")
    return every.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix takes it. Rows alike in id, text and source are
    interchangeable: together they come as often as all of them are taken. Rows are told apart by 128 bits."""
    row = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    tie = F.concat(F.hex(F.xxhash64(*row)), F.lit("-"), F.hex(F.xxhash64(F.lit("row"), *row)))
    taken = mix_sources(docs.withColumn("__tie", tie), id_col="__tie", text_col=text_col, source_col=source_col, **how)
    totals = shared_table(taken.groupBy("__tie").agg(F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__rows")), "mix-copies")
    rows = docs.withColumn("__tie", tie)
    if totals.filter("__rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["__tie"])
    # by shuffle at every size: the copies grow with the documents
    return rows.join(totals.filter("__n > 0").hint("merge"), "__tie").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
