"""N-gram Jaccard join by a blocked sparse matrix product.

The matrix has a row for each different set of word n-grams and a column for each n-gram; the product of the matrix with
its transpose counts what two sets share. Only its leading part is multiplied: with the n-grams of every set in one order,
rare ones first, two sets of sizes n and m that share a or more of them share some of the first n - a + l and m - a + l,
l at least. Columns are dealt into blocks; a block adds up the overlaps of its pairs, leaving out pairs whose sizes or
places in the column can't reach a. Sums over all blocks below l are discarded; what is left is compared on whole sets.

A column of many sets isn't multiplied out. Columns with the same smallest set make a block of sets, each in it once, and a block
meets as a whole: a task compares sketches of its sets, the n-grams counted by hash modulo 2, which bound the difference
of two sets from below. Only sets with a partner by that are sent to the block whole; there the pairs are compared, and a
link is given where it joins two components, so a block gives fewer links than it has sets. A block too large for a task is
dealt into cells that first meet alone; then the sets that aren't in the block's largest component meet all its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, shared_table, shuffle_partitions, with_mark
from .similar import shingles
from .simhash import classified, components, with_row_keys

SEED = 42
WORDS, SIMILARITY = 4, 85
#: n-grams that pairs must share among their first ones (l above), if they have to share so many at all.
LEVEL = 3
#: Sets of a column whose pairs are all multiplied; sets of a block's cell, about, in one task, and n-grams in them all, about.
DIRECT_ROWS, CELL_ROWS, CELL_GRAMS = 16, 2048, 4_000_000
#: Times, at most, that the cells of large blocks meet alone, dealt differently each time, before cells meet each other.
ROUNDS = 3
#: Bits of a sketch: at least two for each n-gram, within these powers of two.
SKETCH_BITS = 9, 16
#: n-grams of a task that are counted at a time; a count of FREQUENT there makes one frequent; as many as HOT, those that
#: are frequent most often, are ordered by that and broadcast, 12 bytes each. That is for speed only.
COUNTED, FREQUENT, HOT = 4_000_000, 4, 1 << 18


def least_common(n: np.ndarray, m: np.ndarray, similarity: int) -> np.ndarray:
    """What sets of sizes n and m share at least if they are similar enough."""
    return -(-similarity * (n + m) // (100 + similarity))


def leading(n: int, similarity: int) -> int:
    """The n-grams of a set of n that the product needs."""
    smallest = -(-similarity * n // 100)
    return min(n, n - -(-similarity * (n + smallest) // (100 + similarity)) + LEVEL)


def sketch(s: np.ndarray) -> bytes:
    """For each value of some last bits of a set's n-grams whether an odd number of them ends so. Each part in which two
    sketches differ holds an n-gram that one set has and the other has not."""
    bits = 1 << min(SKETCH_BITS[1], max(SKETCH_BITS[0], (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def odd_parts(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many parts each row of sketches differs from one other; the larger ones are folded to the size of the smaller."""
    words = min(sketches.shape[1], len(one))
    if len(one) > words:
        one = np.bitwise_xor.reduce(one.reshape(-1, words))
    if sketches.shape[1] > words:
        sketches = np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)
    return np.bitwise_count(sketches ^ one).sum(axis=1, dtype=np.int64)


def most_different(n: np.ndarray, m: np.ndarray, similarity: int) -> np.ndarray:
    """What is in one of two sets of sizes n and m only, at most, if they are similar enough; below zero: they can't be."""
    common = least_common(n, m, similarity)
    return np.where(common <= np.minimum(n, m), n + m - 2 * common, -1)


def similar_sets(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= similarity * (len(x) + len(y) - common)


def _frequent(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, the place of each by its frequency) of the most frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            often = n >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py(), words))
                size += len(held[-1])
                if size > COUNTED:
                    yield counts()
                    held, size = [], 0
        yield counts()

    counted = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(HOT).toArrow()
    grams, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _rows(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: int, cell_rows: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, k1, k2: of the row; fp: what stands for the set; n: its size; first: its leading n-grams; cells: that their
    columns are dealt into; sketch) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("k1", "k2", "fp", "n")], T.StructField("first", T.ArrayType(T.LongType())), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, often = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                fp, n, first, cells, sketches = [], [], [], [], []
                for t in batch.column(3):
                    s = shingles(t.as_py(), words)
                    count = np.zeros(len(s), np.int64)
                    if len(grams):
                        place = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                        count = np.where(grams[place] == s, often[place], 0)
                    head = np.lexsort([s, count])[: leading(len(s), similarity)]
                    fp.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    n.append(len(s))
                    first.append(s[head].view(np.int64))
                    cells.append((1 + count[head] // cell_rows).astype(np.int32))
                    sketches.append(sketch(s))
                columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=schema.names)

    return with_row_keys(docs, id_col, text_col).select(F.col(f"`{id_col}`"), "__k1", "__k2", F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole columns at a time, from rows that come sorted by column and cell, their first two values."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, rows, strict=True)]
        cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        done = int(cuts[-1]) + 1 if len(cuts) else 0
        if done:
            yield [x[:done] for x in rows]
        rest = [x[done:] for x in rows]
    if rest is not None and len(rest[0]):
        yield rest


def _possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether rows i and j of a column can be similar enough, as far as their sizes and places tell; what l is for them)."""
    a = least_common(n[i], n[j], similarity)
    level = np.minimum(LEVEL, a)
    fits = (a <= np.minimum(n[i], n[j])) & (pos[i] < n[i] - a + level) & (pos[j] < n[j] - a + level)
    return fits, level


class _Pairs:
    """Pairs (a, b) with the overlap so far and the least overlap, added up before they leave the task."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, shared: np.ndarray, level: np.ndarray) -> None:
        self.parts.append((np.minimum(a, b), np.maximum(a, b), shared, level))
        self.held += len(a)

    def out(self) -> pa.RecordBatch:
        a, b, shared, level = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*self.parts, strict=True) if self.parts else [[]] * 4))
        self.parts, self.held = [], 0
        order = np.lexsort([b, a])
        a, b, shared, level = (x[order] for x in (a, b, shared, level))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        shared = np.add.reduceat(shared, first) if len(a) else shared
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], shared, level[first])], names=["a", "b", "shared", "level"])


PAIR = "kind int, a long, b long, shared long, level long"


def _kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, kind, np.int32)), *batch.columns], names=["kind", "a", "b", "shared", "level"])


def _multiply(similarity: int, direct_rows: int):
    """From rows (gram, cell, cells, fp, n, pos): overlaps of pairs in small columns, as kind 0; rows (gram, fp, n, pos) of
    the other columns, as kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Pairs()
        for gram, cell, cells, fp, n, pos in _columns(batches):
            start = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])]))
            size = np.diff(np.append(start, len(gram)))
            column = np.repeat(np.arange(len(start)), size)
            size = size[column]
            more = (size > direct_rows) | (cells > 1)
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(more.sum()), np.int32)), *(pa.array(x[more]) for x in (gram, fp, n, pos))], names=["kind", "a", "b", "shared", "level"])
            small = np.flatnonzero((size > 1) & ~more)
            for k in range(1, direct_rows):
                i, j = small[:-k], small[k:]
                i, j = i[x := column[i] == column[j]], j[x]
                if not len(i):
                    break
                fits, level = _possible(i, j, n, pos, similarity)
                found.add(fp[i[fits]], fp[j[fits]], np.ones(int(fits.sum()), np.int64), level[fits])
            if found.held > 500_000:
                yield _kind(found.out(), 0)
        yield _kind(found.out(), 0)

    return run


class _Block:
    """Sets of one cell of a block, and the guests that they meet. With the sets whole, it finds links that join different
    components; with sketches, the sets that have a partner in another component."""

    def __init__(self, label: int, cell: int, similarity: int, whole: bool):
        self.label, self.cell, self.similarity, self.whole = label, cell, similarity, whole
        self.parts: list[list[np.ndarray]] = []
        self.above: dict[int, int] = {}
        self.found: list[tuple] = []
        self.closed = False

    def _sizes(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([len(x) // 8 for x in rows[6]], np.int64) if self.whole else rows[5]

    def _read(self, rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray] | None, list[np.ndarray]]:
        """(guest, fp, root and n; the sets; the sketches) of rows."""
        data = [np.frombuffer(x, np.uint64) for x in rows[6]]
        return rows[2:6], data if self.whole else None, [np.frombuffer(sketch(s), np.uint64) for s in data] if self.whole else data

    def close(self) -> None:
        """The cell's own sets are all there."""
        if self.closed:
            return
        self.closed = True
        rows = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 6 + [np.zeros(0, object)]
        self.parts = []
        rows[5] = self._sizes(rows)
        order = np.argsort(rows[5], kind="stable")
        (self.guest, self.fp, self.root, self.n), self.sets, self.sketches = self._read([x[order] for x in rows])
        self.marked = np.zeros(len(order), bool)
        words = np.array([len(x) for x in self.sketches], np.int64)
        self.sizes = [(at := np.flatnonzero(words == w), np.stack([self.sketches[k] for k in at])) for w in np.unique(words)]

    def _partners(self, n: int, root: int, one: np.ndarray, before: int) -> np.ndarray:
        """Places, below before, of sets of other components that can be similar enough, the most similar first."""
        found, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, sketches in self.sizes:
            low = int(np.searchsorted(self.n[at], -(-self.similarity * n // 100)))
            high = min(int(np.searchsorted(self.n[at], 100 * n // self.similarity, "right")), int(np.searchsorted(at, before)))
            if low < high:
                odd = odd_parts(sketches[low:high], one)
                keep = (odd <= most_different(self.n[at[low:high]], np.int64(n), self.similarity)) & (self.root[at[low:high]] != root)
                found.append(at[low:high][keep])
                parts.append(odd[keep])
        return np.concatenate(found)[np.argsort(np.concatenate(parts), kind="stable")]

    def _top(self, root: int) -> int:
        while root in self.above:
            up = self.above[root]
            if up in self.above:
                self.above[root] = self.above[up]
            root = up
        return root

    def _link(self, fp: int, root: int, s: np.ndarray, partners: np.ndarray) -> None:
        """The links of a set of component root with its partners; self.root follows."""
        while len(partners):
            k, partners = partners[0], partners[1:]
            if similar_sets(s, self.sets[k], self.similarity):
                joined = int(self.root[k])
                self.above[joined] = root
                self.root[self.root == joined] = root
                self.found.append((min(fp, int(self.fp[k])), max(fp, int(self.fp[k]))))
                partners = partners[self.root[partners] != root]

    def meet_own(self) -> None:
        self.close()
        for i in range(len(self.fp)):
            partners = self._partners(int(self.n[i]), int(self.root[i]), self.sketches[i], i)
            if self.whole:
                self._link(int(self.fp[i]), int(self.root[i]), self.sets[i], partners)
            elif len(partners):
                self.marked[i] = self.marked[partners] = True

    def meet_guests(self, rows: list[np.ndarray]) -> None:
        """Of two sets that are guests in each other's cell the one with the smaller fp is the guest."""
        self.close()
        (guest, fp, root, _), sets, sketches = self._read(rows)
        n = self._sizes(rows)
        for i in range(len(fp)):
            now = self._top(int(root[i]))
            partners = self._partners(int(n[i]), now, sketches[i], len(self.fp))
            partners = partners[(self.guest[partners] == 0) | (self.fp[partners] > fp[i])]
            if self.whole:
                self._link(int(fp[i]), now, sets[i], partners)
            elif len(partners):
                self.marked[partners] = True
                self.found.append((self.label, self.cell, int(guest[i]), int(fp[i]), int(root[i]), int(n[i])))

    def end(self) -> list[tuple]:
        self.close()
        own = [(self.label, self.cell, int(self.guest[k]), int(self.fp[k]), int(self.root[k]), int(self.n[k])) for k in np.flatnonzero(self.marked)]
        return self.found + own


MARKED, LINK = "label long, cell int, guest int, fp long, root long, n long", "a long, b long"


def _in_blocks(similarity: int, facing: bool, whole: bool):
    """From rows (label, cell, guest, fp, root, n, and the sketch or the whole set), sorted by the first three, MARKED or LINK
    rows. guest: 0 in its own cell, 1 also a guest elsewhere, 2 a guest here. facing: guests meet the cell's sets; else
    these meet each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in (LINK if whole else MARKED).split(", ")])
        block: _Block | None = None
        out: list[tuple] = []

        def ended() -> list[tuple]:
            if block is not None and not facing:
                block.meet_own()
            return block.end() if block is not None else []

        def given() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            label, cell, here = rows[0], rows[1], rows[2] < 2
            cuts = np.flatnonzero((label[1:] != label[:-1]) | (cell[1:] != cell[:-1]) | (here[1:] != here[:-1])) + 1
            for at, end in zip([0, *cuts], [*cuts, len(label)], strict=True):
                if at == end:
                    continue
                part = [x[at:end] for x in rows]
                if block is None or (block.label, block.cell) != (int(label[at]), int(cell[at])):
                    out += ended()
                    block = _Block(int(label[at]), int(cell[at]), similarity, whole)
                if here[at]:
                    block.parts.append(part)
                else:
                    block.meet_guests(part)
            if len(out) > 50_000:
                yield given()
                out = []
        out += ended()
        yield given()

    return run


def _alike(similarity: int):
    """Those of pairs (a, b, n_a, n_b, sketch_a, sketch_b) that can be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n, m, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            odd = np.array([odd_parts(np.frombuffer(p, np.uint64)[None], np.frombuffer(q, np.uint64))[0] for p, q in zip(x, y, strict=True)], np.int64)
            keep = pa.array(odd <= most_different(n, m, similarity))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return run


class JaccardJoin:
    """Links among the different sets of a table's texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: int, direct_rows: int = DIRECT_ROWS, cell_rows: int = CELL_ROWS, rounds: int = ROUNDS):
        self.docs, self.id_col, self.text_col, self.words, self.similarity = docs, id_col, text_col, words, similarity
        self.direct_rows, self.cell_rows, self.rounds = direct_rows, cell_rows, rounds
        self.rows = shared_table(_rows(docs, id_col, text_col, words, similarity, cell_rows, _frequent(docs, text_col, words)), "jaccard-rows")
        sets = self.rows.filter("n > 0").groupBy("fp")
        self.nodes = shared_table(sets.agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch"), F.min(F.struct("k1", "k2")).alias("row")), "jaccard-sets")

    def _blocks(self, df: DataFrame) -> DataFrame:
        return df.repartition(shuffle_partitions(df.sparkSession), "label", "cell").sortWithinPartitions("label", "cell", "guest")

    def _sketched(self, fps: DataFrame) -> DataFrame:
        """(fp, n, sketch) of sets, those of fps among them."""
        few = with_mark(self.nodes.select("fp", "n", "sketch"), "fp", bit_map(fps.distinct(), "fp"))
        return shared_table(few.filter("__marked").select("fp", "n", "sketch"), "jaccard-sketches")

    def _alike(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that can be similar enough."""
        of = [sketches.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b")]
        both = pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        return shared_table(both.mapInArrow(_alike(self.similarity), LINK), "jaccard-alike")

    def _grouped(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) as blocks of their own: the set a and all its partners go to the smallest of them."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
        rows = pairs.join(label, "a").select("label", F.explode(F.array("a", "b")).alias("fp")).distinct()
        return rows.select("label", F.lit(-1).alias("cell"), F.lit(0).alias("guest"), "fp", F.col("fp").alias("root"))

    def _labelled(self, large: DataFrame) -> DataFrame:
        """(label, cells, fp, n) of each set of each block. Blocks are columns (gram, fp, n) with the same smallest fp, which
        is their label; cells: so many that a task can hold one."""
        label = large.groupBy("gram").agg(F.min("fp").alias("label"))
        members = shared_table(large.join(label, "gram").select("label", "fp", "n").distinct(), "jaccard-members")
        cells = F.ceil(F.greatest(F.count(F.lit(1)) / self.cell_rows, F.sum("n") / CELL_GRAMS)).cast("int")
        return members.join(members.groupBy("label").agg(cells.alias("cells")), "label").select("label", "cells", "fp", "n")

    def _open(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """(label, cells, main: the component with most sets, root, fp, n) of blocks of several cells and components."""
        roots = components(links)
        rows = members.filter("cells > 1").join(roots, F.col("fp") == F.col("node"), "left").select("label", "cells", F.coalesce("root", "fp").alias("root"), "fp", "n")
        rows = shared_table(rows, "jaccard-rooted")
        shares = rows.groupBy("label", "root").agg(F.count(F.lit(1)).alias("rows"))
        several = shares.groupBy("label").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        return shared_table(rows.join(several, "label").select("label", "cells", "main", "root", "fp", "n"), "jaccard-open")

    def _marked(self, rows: DataFrame, sketches: DataFrame, facing: bool) -> DataFrame:
        """Those of rows (label, cell, guest, fp, root, n) that have a partner, by sketches."""
        dealt = self._blocks(rows.join(sketches.select("fp", "sketch"), "fp").select("label", "cell", "guest", "fp", "root", "n", "sketch"))
        return shared_table(dealt.mapInArrow(_in_blocks(self.similarity, facing, False), MARKED), "jaccard-marked")

    def _linked(self, marked: DataFrame, facing: bool) -> DataFrame:
        """Links (a, b) between components among marked rows. The sets are made anew from the text of one row of each, and go
        from there to their blocks."""
        words = self.words
        to = marked.groupBy("fp").agg(F.collect_list(F.struct("label", "cell", "guest", "root")).alias("to"))
        keys = shared_table(self.nodes.select("fp", F.col("row.k1").alias("__k1"), F.col("row.k2").alias("__k2")).join(to, "fp").withColumnRenamed("fp", "__fp").withColumnRenamed("to", "__to"), "jaccard-needed")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(2)], pa.binary())], names=["fp", "to", "s"])

        texts = with_row_keys(self.docs, self.id_col, self.text_col).select("__k1", "__k2", F.col(f"`{self.text_col}`").alias("__text"))
        found = with_mark(texts, "__k1", bit_map(keys, "__k1")).filter("__marked").join(keys, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"])
        sets = found.select("__fp", "__to", "__text").mapInArrow(run, "fp long, to array<struct<label: long, cell: int, guest: int, root: long>>, s binary")
        dealt = self._blocks(sets.select("fp", "s", F.explode("to").alias("x")).select("x.label", "x.cell", "x.guest", "fp", "x.root", F.lit(0).cast("long").alias("n"), "s"))
        return shared_table(dealt.mapInArrow(_in_blocks(self.similarity, facing, True), LINK), "jaccard-links")

    def links(self) -> DataFrame:
        """Links (a, b) between sets by their fps: they join all that are similar enough, and no more."""
        at = F.posexplode(F.arrays_zip("first", "cells")).alias("pos", "x")
        entries = self.nodes.select("fp", "n", at).select(F.col("x.first").alias("gram"), F.col("x.cells").alias("cells"), "fp", "n", F.col("pos").cast("long").alias("pos"))
        entries = entries.withColumn("cell", F.pmod(F.xxhash64("fp", "gram"), F.col("cells")).cast("int"))
        blocks = entries.select("gram", "cell", "cells", "fp", "n", "pos").repartition(shuffle_partitions(self.docs.sparkSession), "gram", "cell").sortWithinPartitions("gram", "cell")
        product = shared_table(blocks.mapInArrow(_multiply(self.similarity, self.direct_rows), PAIR), "jaccard-product")
        summed = product.filter("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("level").alias("level"))
        pairs = shared_table(summed.filter("shared >= level").select("a", "b"), "jaccard-pairs")
        members = shared_table(self._labelled(product.filter("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("fp"), F.col("shared").alias("n"))), "jaccard-blocks")

        ends = F.explode(F.array("a", "b")).alias("fp")
        sketches = self._sketched(members.select("fp").unionByName(pairs.select(ends)))
        pairs = self._alike(pairs, sketches)

        def own(rows: DataFrame, turn: int, guest: Column) -> DataFrame:
            cell = F.pmod(F.xxhash64("fp", "label", F.lit(turn)), F.col("cells")).cast("int")
            return rows.select("label", cell.alias("cell"), guest.alias("guest"), "fp", "root", "n")

        first = own((members if self.rounds else members.filter("cells = 1")).withColumn("root", F.col("fp")), 0, F.lit(0))
        links = self._linked(self._marked(first, sketches, False).drop("n").unionByName(self._grouped(pairs)), False)
        if not members.filter("cells > 1").limit(1).count():
            return links
        rows = self._open(members, links)
        for turn in range(1, self.rounds):
            marked = self._marked(own(rows, turn, F.lit(0)), sketches, False)
            if not marked.limit(1).count():
                break
            links = links.unionByName(self._linked(marked, False))
            rows = self._open(members, links)
        # each set in its cell, and those that aren't of their block's main component in every cell of it, as guests
        away = F.col("root") != F.col("main")
        here = own(rows, 0, away.cast("int"))
        guests = rows.filter(away).select("label", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(2).alias("guest"), "fp", "root", "n")
        marked = self._marked(here.unionByName(guests), sketches, True)
        return links.unionByName(self._linked(marked, True))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY, **how: int) -> DataFrame:
    """One row per row of docs: its id, n_shingles (long: different n-grams of words, A-Z lower-cased), component_id (the
    smallest id reachable over links, its own included).

    Two texts link if their sets of n-grams have a Jaccard similarity of `similarity` per cent or more. A text of fewer
    words is one n-gram; one without words, a null text too, has none, links with nothing and is its own component.
    Null ids take part but are never the smallest, so a component of null ids only has a null component_id. Equal rows
    give equal rows. Other columns aren't read. An n-gram, and a set of them, is told from others by 64 bits. No rows in:
    no rows out.
    """
    join = JaccardJoin(docs, id_col, text_col, words, similarity, **how)
    linked = classified(join.rows.filter("n > 0").select("id", "n", "fp"), join.nodes.select("fp", "least"), join.links())
    alone = join.rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.select("id", "n", "component_id").unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
