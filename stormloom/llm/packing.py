"""Best-fit packing of token sequences by minimum bin slack.

A bin starts with the longest piece left; a subset-sum over the lengths available, as a bit set with one bit per
reachable sum, finds the fullest way to complete it. Only lengths matter for that, so the search runs over the number
of pieces of each length, and a combination found is used as often as those numbers allow. The plan is therefore
bounded by the bin's size, whatever the number of documents; each piece then finds its bin by its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table, shuffle_partitions
from .tokens import encode, load_model, slices, transducer


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """[(length, how many)] of the multiset that fills room best. lengths: those of counts, longest first; on ties the
    longer lengths are used first."""
    reach, trail, mask = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left > 0:  # 1, 2, 4, ... of this length, then the rest
            k = min(k, left)
            trail.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, k = left - k, 2 * k
            if reach >> room:
                break
        if reach >> room:
            break
    best, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(trail):
        if not before >> best & 1:
            best -= n * k
            out[n] = out.get(n, 0) + k
    return sorted(out.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(length, how many in each)])] that use up counts (number of pieces of each length > 0)."""
    counts = {n: c for n, c in counts.items() if c}
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        rest = dict(fullest(counts, lengths, capacity - first))
        counts[first] += 1
        rest[first] = rest.get(first, 0) + 1
        times = min(counts[n] // k for n, k in rest.items())
        plan.append((times, sorted(rest.items(), reverse=True)))
        for n, k in rest.items():
            counts[n] -= times * k
        if any(not counts[n] for n in rest):
            lengths = [n for n in lengths if counts[n]]
    return plan


def layout(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first bin, pieces per bin and place of the first piece, of each entry of the plan."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    at = 0
    for times, items in plan:
        place = 0
        for n, k in items:
            rows.setdefault(n, []).append((ranks.get(n, 0), at, k, place))
            ranks[n] = ranks.get(n, 0) + times * k
            place += n * k
        at += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids with end_id after them, cut at capacity."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(tokenizer_path))
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model.value)
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(machine, texts), begin):
                    data = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(data), capacity):
                        part = data[k : k + capacity]
                        row.append(i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[f.name for f in schema.fields])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order: list[str] | None = None) -> DataFrame:
    """pieces with `sequence_id` and `offset` (long): its bin and its place there, gapless from 0.

    A piece longer than capacity fails. order: columns that order pieces of one length (default: all atomic ones).
    Pieces alike in all of them are interchangeable. Columns named like an output are replaced. No rows in: no rows out.
    The driver holds the number of pieces of each length, at most `capacity` numbers, and the plan made from them.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    length = F.col(f"`{length_col}`").cast("long")
    order = order or [c for c in names if isinstance(pieces.schema[c].dataType, T.AtomicType)]
    salts = shuffle_partitions(pieces.sparkSession)  # ranks are counted within a part of each length's pieces
    rows = pieces.select(*[F.col(f"`{c}`") for c in names], length.alias("__n"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(salts)).alias("__salt"))
    rows = shared_table(rows, "pieces")
    counts = shared_table(rows.groupBy("__n", "__salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("__n").agg(F.sum("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece of {max(histogram)} doesn't fit into {capacity}")
    before = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("__n").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("__n", "__salt").orderBy(*[F.col(f"`{c}`") for c in order]))
    ranked = rows.withColumn("__own", own).join(before, ["__n", "__salt"]).withColumn("__rank", F.col("first") + F.col("__own") - 1)
    bins = pieces.sparkSession.sparkContext.broadcast(layout(plan_bins(histogram, capacity)))
    schema = T.StructType([*[pieces.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__n", "__rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for v in np.unique(n):
                at = np.flatnonzero(n == v)
                first, bin_, each, where = bins.value[int(v)]
                e = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[e]
                sequence[at], offset[at] = bin_[e] + k // each[e], where[e] + k % each[e] * v
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*[F.col(f"`{c}`") for c in names], "__n", "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece (int), start, length, ids_crc32, sequence_id, offset (long).

    A null text is empty: its document is the end id alone. Rows alike in id and text are packed one by one. Other
    columns aren't read. No rows in: no rows out.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
