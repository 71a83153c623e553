"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in few bits agree in at least one of some blocks of bits; the topmost nodes of the index are
the patterns of one block's first bits, as many as bring a node to some hundred fingerprints. A node with too many gets
nodes below it that fix a further block, as often as needed, so no task holds an unbounded group. Inside a node the
fingerprints are sorted by Gray rank, neighbours form groups, and a group's common bits are kept once, at the highest
group that has them. A search takes some neighbouring fingerprints at a time, adds up the differing bits on its way down
and drops a whole group once they are too many for all of them. Links become components by alternating large-star and
small-star steps over tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, shared_table, shuffle_partitions, with_mark

SEED = 42
#: Fingerprints that a node has on average, where the table allows it, and that a task searches at most; a fuller node
#: is divided by further blocks.
NODE_TARGET, NODE_ROWS = 512, 2048
#: Fingerprints or groups under one group of the index; neighbouring fingerprints that are searched for at once.
FAN_OUT, ASKED = 8, 64

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_BYTE_OF = (256 * np.arange(8)).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OF
    counts = np.bincount(lanes.reshape(-1), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.reshape(-1) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The majority of the shingles' hashes; no words: 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = (np.cumsum([len(w) + 1 for w in found]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64))


def with_row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __k1 and __k2, 128 bits that stand for a row's id and text."""
    row = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return docs.withColumns({"__k1": F.xxhash64(*row), "__k2": F.xxhash64(F.lit("row"), *row)})


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id, k1, k2, fp: long) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("k1", "k2", "fp")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], names=schema.names)

    return with_row_keys(docs, id_col, text_col).select(F.col(f"`{id_col}`"), "__k1", "__k2", F.col(f"`{text_col}`")).mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a word in the Gray-code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(fps: np.ndarray) -> np.ndarray:
    """The order of rows of one or more words by Gray rank: a word after an odd number of set bits runs backwards."""
    ranks = []
    for k in range(fps.shape[1]):
        rank = gray_rank(fps[:, k])
        ranks.append(np.where(ranks[-1] & np.uint64(1), ~rank, rank) if k else rank)
    return np.lexsort(ranks[::-1])


def differing(q: np.ndarray, value: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bits of mask in which each row of q differs from each row of value."""
    return sum(np.bitwise_count((q[:, None, w] ^ value[None, :, w]) & mask[None, :, w]).astype(np.int16) for w in range(q.shape[1]))


class GrayIndex:
    """Hierarchical groups over fingerprints, rows of one or more words, in Gray order. levels[0] are groups of
    fingerprints, the last the roots. `compared` counts the groups that searches looked at, `dropped` those that they
    left with all that is below."""

    def __init__(self, fps: np.ndarray):
        self.order = gray_order(fps)
        self.fps = both = either = fps[self.order]
        self.compared = self.dropped = 0
        levels = []
        while True:
            cuts = np.arange(0, len(both), FAN_OUT)
            both, either = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)
            levels.append((~(both ^ either), both))  # bits on which all members agree, and their values
            if len(cuts) <= FAN_OUT:
                break
        #: (bits first shared at this level, their values)
        self.levels = []
        for k, (mask, value) in enumerate(levels):
            above = np.repeat(levels[k + 1][0], FAN_OUT, axis=0)[: len(mask)] if k + 1 < len(levels) else np.zeros_like(mask)
            self.levels.append((mask & ~above, value))
        self.own = ~np.repeat(levels[0][0], FAN_OUT, axis=0)[: len(self.fps)]

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places i < j in self.fps that differ in at most `distance` bits, for some queries at a time."""
        n = len(self.fps)
        for begin in range(0, n, ASKED):
            q = self.fps[begin : begin + ASKED]
            group = np.arange(len(self.levels[-1][0]))
            apart = np.zeros((len(q), len(group)), np.int16)
            span = FAN_OUT ** len(self.levels)
            for k in range(len(self.levels) - 1, -1, -1):
                mask, value = self.levels[k]
                apart = apart + differing(q, value[group], mask[group])
                keep = (apart <= distance).any(0) & ((group + 1) * span > begin)  # and not wholly before the queries
                self.compared += len(group)
                self.dropped += len(group) - int(keep.sum())
                below = (group[keep][:, None] * FAN_OUT + np.arange(FAN_OUT)).reshape(-1)
                real = below < (len(self.levels[k - 1][0]) if k else n)
                group, apart = below[real], np.repeat(apart[:, keep], FAN_OUT, axis=1)[:, real]
                span //= FAN_OUT
            i, j = np.nonzero(apart + differing(q, self.fps[group], self.own[group]) <= distance)
            i, j = i + begin, group[j]
            yield i[j > i], j[j > i]


def smallest_reachable(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest one it is linked with, directly or not."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def node_links(fps: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what is linked within each node (rows are sorted by node): (fingerprint, root)."""
    a_out, b_out = [fps[:0]], [fps[:0]]
    cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(fps) else []
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end - at > 1:
            index = GrayIndex(fps[at:end, None])
            root = smallest_reachable(end - at, index.links(distance))
            other = np.flatnonzero(root != np.arange(end - at))
            a_out.append(index.fps[other, 0])
            b_out.append(index.fps[root[other], 0])
    return np.concatenate(a_out), np.concatenate(b_out)


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (path, fixed, fp) come sorted by node; the last, unfinished node of a batch waits for the next."""
    rest: list[np.ndarray] | None = None

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        node = np.concatenate([[0], np.cumsum((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))]) if len(rows[0]) else rows[0]
        a, b = node_links(rows[2].view(np.uint64), node, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        rows = rows if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, rows, strict=True)]
        if not len(rows[0]):
            continue
        done = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if (rows[0][0], rows[1][0]) != (rows[0][-1], rows[1][-1]) else 0
        rest = [x[done:] for x in rows]
        if done:
            yield edges([x[:done] for x in rows])
    if rest is not None:
        yield edges(rest)


def _divide(free: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(free, parts)]


def node_bits(n: int, target: int = NODE_TARGET, most: int = 16) -> int:
    """Bits of a block that divide n fingerprints into nodes of about `target`."""
    return min(most, max(0, math.ceil(math.log2(max(n, 1) / target))))


def near_links(nodes: DataFrame, distance: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints `fp` of nodes: they join all that differ in at most `distance` bits,
    directly or through others, and no more."""
    spark = nodes.sparkSession
    parts = distance + 1
    bits = node_bits(nodes.count())
    free = {0: list(range(64))}  # path: bits that it leaves open
    fixed = {0: 0}
    rows = nodes.select(F.lit(0).cast("long").alias("path"), "fp")
    schema, found = "a long, b long", None
    while True:
        below: list[tuple[int, int, int]] = []
        for path in list(free):
            for k, chosen in enumerate(_divide(free[path], parts) if bits else [[]]):
                chosen = chosen[:bits]
                child = path * (parts + 1) + k + 1
                mask = fixed[path] | sum(1 << int(b) for b in chosen)
                below.append((path, child, mask - (1 << 64) if mask >> 63 else mask))
                free[child], fixed[child] = [b for b in free[path] if b not in chosen], mask
            del free[path], fixed[path]
        bits = 64  # further blocks are fixed whole
        if len(below) <= parts:  # below the root
            children = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("child"), F.lit(m).cast("long").alias("mask")) for _, c, m in below]))
            rows = rows.select("fp", children.alias("at")).select("fp", "at.*")
        else:  # a few rows for each block pattern of the levels above
            rows = rows.join(F.broadcast(spark.createDataFrame(below, "path long, child long, mask long")), "path")
        rows = rows.select(F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("fixed"), "fp")
        sizes = rows.groupBy("path", "fixed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_rows)
        full = shared_table(sizes.select("path", "fixed"), "simhash-full")
        is_full = full.count() > 0 and all(len(f) > parts for f in free.values())
        here = rows.join(full, ["path", "fixed"], "left_anti") if is_full else rows
        here = here.repartition(shuffle_partitions(spark), "path", "fixed").sortWithinPartitions("path", "fixed")
        links = here.mapInArrow(lambda batches: _search(batches, distance), schema)
        found = links if found is None else found.unionByName(links)
        if not is_full:
            return found
        rows = shared_table(rows.join(full, ["path", "fixed"], "left_semi").select("path", "fp"), "simhash-below")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node of links (a, b)."""

    def ordered(df: DataFrame) -> DataFrame:
        return df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = shared_table(ordered(links), "links")
    last = state(links)
    while last[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = shared_table(ordered(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        links = shared_table(ordered(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))), "small-star")
        if (now := state(links)) == last:
            break
        last = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classified(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rows (fp and others) with `root`, the node that stands for the component, and `component_id`, its smallest id.
    nodes: (fp, least: its smallest id) of every fp; links (a, b) between nodes."""
    roots = components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = shared_table(rooted.join(ids, "root").select("fp", "root", "component_id"), "fingerprint-classes")
    return rows.join(classes, "fp")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, node_rows: int) -> DataFrame:
    fps = shared_table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = shared_table(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    return classified(fps, nodes, near_links(nodes.select("fp"), distance, node_rows))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per row of docs: its id, fp (long: the 64 bits), component_id (the smallest id reachable over links).

    Texts link whose fingerprints differ in at most `distance` bits. A null text is one without words; all those have
    fingerprint zero and link like others. Texts of fewer than `words` words are one shingle. Null ids take part but
    are never the smallest, so a component of null ids only has a null component_id. Equal rows give equal rows. Other
    columns aren't read. No rows in: no rows out.
    """
    return _classes(docs, id_col, text_col, words, distance, node_rows).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """The rows of docs that stay: of each component one row, that with the smallest id (of several with that id, of
    different texts, the one with the smallest hash). Rows of null id are kept only where a component has no other id,
    all of them."""
    return keep_one_each(docs, _classes(docs, id_col, text_col, words, distance, node_rows), id_col, text_col)


def keep_one_each(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, as drop_near_duplicates() states. classes: (id, k1, k2, root) of every row. Only rows
    that a bit map marks, those that go and a few others, are shuffled."""
    named = shared_table(classes.filter("id IS NOT NULL").groupBy("root", "id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    least = named.groupBy("root").agg(F.min(F.struct("id", "k1", "k2")).alias("stays"))
    nameless = classes.filter("id IS NULL").select("root", "k1", "k2").distinct().withColumn("n", F.lit(0))
    every = named.select("root", "k1", "k2", "n").unionByName(nameless).join(least, "root")
    stays = (F.col("k1") == F.col("stays.k1")) & (F.col("k2") == F.col("stays.k2")) & (F.col("n") > 0)
    # rows that go, and rows that stay once of several alike
    touched = shared_table(every.select("k1", "k2", (~stays).alias("goes"), "n").filter("goes OR n > 1"), "near-gone")
    keyed = with_mark(with_row_keys(docs, id_col, text_col), "__k1", bit_map(touched, "k1"))
    gone = touched.filter("goes").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    marked = keyed.filter("__marked").join(gone, ["__k1", "__k2"], "left_anti")
    if touched.filter("NOT goes").limit(1).count():
        alone = F.when(F.col(f"`{id_col}`").isNull(), F.monotonically_increasing_id())
        marked = marked.withColumn("__alone", alone).dropDuplicates(["__k1", "__k2", "__alone"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.filter("NOT __marked").select(*names).unionByName(marked.select(*names))
