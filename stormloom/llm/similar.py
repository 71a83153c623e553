"""SimHash near-duplicates by similarity: texts link whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from fingerprints of 128 bits over five-word shingles. At a similarity of 0.8 about 19 bits differ, between
unrelated texts about 64. The top nodes of the index are the patterns of some bits drawn for each of several tables, so
many bits as make nodes of some hundred fingerprints and so many tables as let a pair meet in one; below them a Gray-order
index finds all pairs up to RADIUS bits. Each link is verified on the whole shingle sets.

Small groups of candidates give all their pairs. Larger ones first give the pairs with some leaders, and nodes too full
for a task are dealt into cells; once those links are made components, every pair of a group or node that is in two
components still is compared, in place. So a large group of copies takes few comparisons, and no pair that meets in a node
goes untested unless other links join it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, shared_table, shuffle_partitions, with_mark, worker_state
from .simhash import GrayIndex, classified, components, differing, keep_one_each, majority, node_bits, smallest_reachable, with_row_keys

SEED = 42
WORDS = 5
#: Percentage of Jaccard similarity from which texts link.
SIMILARITY = 80
#: Candidates differ in at most so many of 128 bits.
RADIUS = 38
#: A pair that differs in TYPICAL of 128 bits (at a similarity of 0.8: 19.4 on average, 4.1 standard deviation) is in no
#: common node with a probability of MISSED.
TYPICAL, MISSED = 24, 0.01
#: Fingerprints of a node on average, at most; of a cell at most, about; of a group of candidates that gives all its pairs at once.
NODE_TARGET, CELL_ROWS, DIRECT_ROWS = 1024, 4096, 8
LEADERS = 3
#: Full nodes up to which their list is broadcast, 16 bytes each.
BROADCAST_NODES = 100_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; of a shorter text, of all its words. No words: none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = (np.cumsum([len(w) + 1 for w in found]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(found)) - 1 :], strict=False)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits as two words: the majority of the hashes, and that of the hashes mixed once more."""
    if not len(hashes):
        return 0, 0
    return majority(hashes), majority((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15))


def block_tables(n: int) -> list[tuple[int, int]]:
    """The masks (two words) of each table's bits, for n fingerprints."""
    bits = node_bits(n, NODE_TARGET, 48)
    if not bits:
        return [(0, 0)]
    rng = random.Random(SEED)
    agrees = math.prod((128 - TYPICAL - k) / (128 - k) for k in range(bits))
    out = []
    for _ in range(math.ceil(math.log(MISSED) / math.log1p(-agrees))):
        mask = sum(1 << b for b in rng.sample(range(128), bits))
        out.append((mask & (2**64 - 1), mask >> 64))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2: of the row; fp: what stands for the set of shingles; n: its size; w0, w1: its fingerprint) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("k1", "k2", "fp", "n", "w0", "w1")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("similar",), lambda: None)  # another operator's state goes
        for batch in batches:
            rows = np.zeros((batch.num_rows, 4), np.uint64)
            for i, t in enumerate(batch.column(3)):
                s = shingles(t.as_py())
                rows[i] = (xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), *wide_fingerprint(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in rows.T.view(np.int64))], names=schema.names)

    return with_row_keys(docs, id_col, text_col).select(F.col(f"`{id_col}`"), "__k1", "__k2", F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each cell, from rows that come sorted by node and cell, their first two columns."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, rows, strict=True)]
        at = 0
        for end in np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1:
            yield [x[at:end] for x in rows]
            at = end
        rest = [x[at:] for x in rows]
    if rest is not None and len(rest[0]):
        yield rest


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)


def _out(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], names=names)


def candidates(fp: np.ndarray, n: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j: pairs of rows within RADIUS whose sizes fit; the smallest row that each row is linked with by such pairs).
    Rows are in the order of fp."""
    index = GrayIndex(wide)
    pairs = []
    for i, j in index.links(RADIUS):
        i, j = index.order[i], index.order[j]
        fits = _alike(n[i], n[j])
        pairs.append((np.minimum(i, j)[fits], np.maximum(i, j)[fits]))
    return *(np.concatenate(x) for x in zip(*pairs, strict=True)), smallest_reachable(len(fp), iter(pairs))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, cell, cells, fp, n, w0, w1): pairs (a, b) to verify, with node 0; and the members (node, a, a) of
    what pairs with leaders don't settle: groups of more than DIRECT_ROWS, by a name of their own, and nodes of several
    cells."""
    names = ["node", "a", "b"]
    found: list[list[np.ndarray]] = [[], [], []]
    held = 0
    for node, cell, cells, fp, n, w0, w1 in _parts(batches):
        order = np.argsort(fp)
        fp, n, wide = fp[order], n[order], np.column_stack([w0, w1]).view(np.uint64)[order]
        rows = [[], [], []]
        if len(fp) > 1:
            i, j, root = candidates(fp, n, wide)
            size = np.bincount(root, minlength=len(fp))[root]
            place = np.argsort(root, kind="stable")  # members of a group side by side, in the order of fp
            first = np.flatnonzero(np.concatenate([[True], root[place][1:] != root[place][:-1]]))
            rank = np.empty(len(fp), np.int64)
            rank[place] = np.arange(len(fp)) - np.repeat(first, np.diff(np.append(first, len(fp))))
            keep = (size[i] <= DIRECT_ROWS) | (rank[i] < LEADERS) | (rank[j] < LEADERS)
            rows = [[np.zeros(int(keep.sum()), np.int64)], [fp[i[keep]]], [fp[j[keep]]]]
            if cells[0] == 1:
                more = np.flatnonzero(size > DIRECT_ROWS)
                # a name that its cell in another table doesn't have
                rows = [r + [x] for r, x in zip(rows, (fp[root[more]] ^ (node[0] | 1), fp[more], fp[more]), strict=True)]
        if cells[0] > 1:
            rows = [r + [x] for r, x in zip(rows, (node, fp, fp), strict=True)]
        for c, x in zip(found, rows, strict=True):
            c.extend(x)
        held += sum(map(len, rows[0]))
        if held > 20_000:
            yield _out(found, names)
            found, held = [[], [], []], 0
    yield _out(found, names)


def _facing(rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(a guest's row, the rows of its cell that are candidates with it and of other components). rows: (node, cell,
    guest, fp, root, n, w0, w1)."""
    _, _, guest, _, root, n, w0, w1 = rows[:8]
    here, there = np.flatnonzero(guest == 0), np.flatnonzero(guest == 1)
    wide = np.column_stack([w0, w1]).view(np.uint64)
    every = np.full((len(here), 2), ~np.uint64(0))
    for at in range(0, len(there), 64):
        some = there[at : at + 64]
        open_ = (differing(wide[some], wide[here], every) <= RADIUS) & (root[some][:, None] != root[here]) & _alike(n[some][:, None], n[here])
        for k in np.flatnonzero(open_.any(1)):
            yield some[k], here[open_[k]]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that have a candidate of another component there."""
    for rows in _parts(batches):
        has = np.zeros(len(rows[0]), bool)
        for i, js in _facing(rows):
            has[i] = True
            has[js] = True
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in rows], names=["node", "cell", "guest", "fp", "root", "n", "w0", "w1"])


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of _open with their sets: verified links (a, b), those that join components not joined in the cell."""
    worker_state(("similar",), lambda: None)
    for rows in _parts(batches):
        fp, packed = rows[3], rows[8]
        sets = [np.frombuffer(x, np.uint64) for x in packed]
        size = np.array([len(x) for x in sets])
        cuts = np.cumsum(size) - size
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        label = rows[4].copy()
        a, b = [], []
        for i, js in _facing(rows):
            js = js[label[js] != label[i]]
            if not len(js):
                continue
            has = np.zeros(len(values), np.int64)
            has[code[cuts[i] : cuts[i] + size[i]]] = 1
            common = np.add.reduceat(has[code], cuts)[js]
            for j in js[100 * common >= SIMILARITY * (size[js] + size[i] - common)]:
                if label[j] != label[i]:
                    a.append(fp[i])
                    b.append(fp[j])
                    label[label == label[j]] = label[i]
        yield _out([[np.array(a, np.int64)], [np.array(b, np.int64)]], ["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of pairs (a, b, s_a, s_b: their sets) that are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 100 * common >= SIMILARITY * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])


def _sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, s: the bytes of its set) for the fps of needed, made anew from the text of one row of each."""
    rows = shared_table(nodes.join(needed, "fp", "left_semi").select("fp", F.col("row.k1").alias("__k1"), F.col("row.k2").alias("__k2")), "similar-needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["fp", "s"])

    texts = with_row_keys(docs, id_col, text_col).select("__k1", "__k2", F.col(f"`{text_col}`").alias("__text"))
    texts = with_mark(texts, "__k1", bit_map(rows, "__k1")).filter("__marked")
    found = texts.join(rows, ["__k1", "__k2"]).dropDuplicates(["fp"])  # rows alike in id and text
    return shared_table(found.select("fp", "__text").mapInArrow(run, "fp long, s binary"), "similar-sets")


def similar_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) between the sets of nodes (fp, n, w0, w1, row: k1 and k2 of one row of docs)."""
    spark = docs.sparkSession
    count = nodes.count()

    def key(k: int, masks: tuple[int, int]) -> Column:
        return F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(_signed(m))) for w, m in zip(("w0", "w1"), masks, strict=True)])

    rows = nodes.filter("n > 0").select(F.explode(F.array(*[key(k, m) for k, m in enumerate(block_tables(count))])).alias("node"), "fp", "n", "w0", "w1")
    full = shared_table(rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("cells")).filter("cells > 1"), "similar-full")
    if n_full := full.count():
        rows = rows.join(F.broadcast(full) if n_full <= BROADCAST_NODES else full, "node", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    else:
        rows = rows.withColumn("cells", F.lit(1))
    rows = rows.select("node", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int").alias("cell"), "cells", "fp", "n", "w0", "w1")
    rows = rows.repartition(shuffle_partitions(spark), "node", "cell").sortWithinPartitions("node", "cell")
    found = shared_table(rows.mapInArrow(_first, "node long, a long, b long"), "similar-candidates")

    pairs = shared_table(found.filter("a <> b").select("a", "b").distinct(), "similar-pairs")
    sets = _sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), id_col, text_col)
    left, right = (sets.select(F.col("fp").alias(c), F.col("s").alias(f"s_{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b")
    links = shared_table(both.mapInArrow(_compared, "a long, b long"), "similar-links")

    members = found.filter("a = b").select("node", F.col("a").alias("fp")).distinct()
    if not found.filter("a = b").limit(1).count():
        return links
    roots = components(links)
    members = shared_table(members.join(roots, members["fp"] == roots["node"], "left").select(members["node"], "fp", F.coalesce("root", "fp").alias("root")), "similar-members")
    shares = members.groupBy("node", "root").agg(F.count(F.lit(1)).alias("rows"))
    nodes_open = shares.groupBy("node").agg(F.max_by("root", "rows").alias("main"), F.ceil(F.sum("rows") / CELL_ROWS).cast("int").alias("cells"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    rest = members.join(nodes_open, "node").join(nodes.select("fp", "n", "w0", "w1"), "fp")
    rest = shared_table(rest.select("node", "cells", "main", "fp", "root", "n", "w0", "w1"), "similar-rest")
    columns = ["node", "cell", "guest", "fp", "root", "n", "w0", "w1"]
    here = rest.withColumns({"cell": F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"), "guest": F.lit(0)}).select(columns)
    guests = rest.filter("root <> main").withColumns({"cell": F.explode(F.sequence(F.lit(0), F.col("cells") - 1)), "guest": F.lit(1)}).select(columns)
    facing = here.unionByName(guests).repartition(shuffle_partitions(spark), "node", "cell").sortWithinPartitions("node", "cell")
    kinds = "node long, cell int, guest int, fp long, root long, n long, w0 long, w1 long"
    open_ = shared_table(facing.mapInArrow(_open, kinds), "similar-open")
    if not open_.limit(1).count():
        return links
    sets = _sets(docs, nodes, open_.select("fp").distinct(), id_col, text_col)
    held = open_.join(sets, "fp").select(*columns, "s").repartition(shuffle_partitions(spark), "node", "cell").sortWithinPartitions("node", "cell")
    return links.unionByName(shared_table(held.mapInArrow(_second, "a long, b long"), "similar-more"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sketches = shared_table(_sketches(docs, id_col, text_col), "similar-sketches")
    nodes = sketches.groupBy("fp").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "w0", "w1")], F.min(F.struct("k1", "k2")).alias("row"))
    nodes = shared_table(nodes, "similar-nodes")
    return classified(sketches, nodes.select("fp", "least"), similar_links(docs, nodes, id_col, text_col))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, component_id (the smallest id reachable over links).

    Letters A-Z count as lower case. Texts of fewer than five words are one shingle. Texts without words, null ones too,
    are copies of each other. Null ids take part but are never the smallest, so a component of null ids only has a null
    component_id. Equal rows give equal rows. Other columns aren't read. No rows in: no rows out. The index misses a
    pair at 0.8 with a probability of about 1 in 100, ever fewer above; what it finds is exact.
    """
    return _classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "component_id")


def drop_similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component as keep_one_each() chooses it."""
    return keep_one_each(docs, _classes(docs, id_col, text_col), id_col, text_col)
