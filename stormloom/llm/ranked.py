"""Ranked lexical search over inverted treaps.

Documents are dealt into shards by the number of their postings. A shard keeps one treap for each term: a search tree over
documents in the order of their ids, and a heap over the impacts, so the root of any stretch of documents has the largest
impact there. The treaps of an item's terms are traversed together: a stretch of documents whose roots' impacts add up to
less than the item's k-th best score so far is dropped with all that is below; of any other, the document with the largest
impact is taken out, all treaps are split there, and both sides are looked at again, the most promising stretches first.
Some shards are searched ahead of the others, and what they find is the limit that the others begin with.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table, shuffle_partitions

#: Documents and postings of a shard, about.
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: One shard in so many is searched ahead.
AHEAD_1_IN = 16
#: Shards, or groups of them, whose best documents one group of the next level combines.
FAN_IN = 64
#: Bytes of items that are searched for at once, about; items that a shard traverses for together, and stretches at a time.
ITEM_BYTES, ITEMS, STRETCHES = 8 << 20, 32, 4096

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLDED = bytes(b if b not in range(0x41, 0x5B) else b + 32 for b in range(256))
_TERMS = bytes(32 if b in set(_SEPARATORS) else _FOLDED[b] for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: longest runs of ASCII digits and letters, A-Z lower-cased, and of characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def build_treaps(term: np.ndarray, impact: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each term, left and right child of each posting) for postings in the order of term and document. A missing
    node is len(term). Of equal impacts the first is nearer to the root."""
    n = len(term)
    root, left, right = [n] * n_terms, [n] * (n + 1), [n] * (n + 1)
    values, of, stack, now = impact.tolist(), term.tolist(), [], -1
    for i, v in enumerate(values):
        if of[i] != now:
            if stack:
                root[now] = stack[0]
            now, stack = of[i], []
        last = n
        while stack and values[stack[-1]] < v:
            last = stack.pop()
        left[i] = last
        if stack:
            right[stack[-1]] = i
        stack.append(i)
    if stack:
        root[now] = stack[0]
    return np.array(root, np.int32), np.array(left, np.int32), np.array(right, np.int32)


class Treaps:
    """One shard's treaps. `taken` counts the documents that searches took out."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        """Postings in the order of term and document."""
        self.none, self.n_docs, self.taken = len(doc), n_docs, 0
        self.doc, self.impact = np.append(doc, -1).astype(np.int32), np.append(impact, 0)
        self.root, self.left, self.right = build_treaps(term, impact, n_terms)

    def split(self, roots: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of roots, the treaps of the documents between low and high: the posting of document `at` in each
        treap, the roots of what is before it and of what is behind it."""
        none, width = self.none, roots.shape[1]
        here, before, behind = (np.full(roots.size, none, np.int32) for _ in range(3))
        at, low, high = (np.repeat(x, width) for x in (at, low, high))
        open_ = np.flatnonzero(roots.reshape(-1) != none)
        node = roots.reshape(-1)[open_]
        while len(open_):
            doc, goal = self.doc[node], at[open_]
            less, more = doc < goal, doc > goal
            s = open_[x := less & (before[open_] == none) & (doc > low[open_])]
            before[s] = node[x]
            s = open_[x := more & (behind[open_] == none) & (doc < high[open_])]
            behind[s] = node[x]
            hit = ~(less | more)
            here[open_[hit]] = node[hit]
            node = np.where(less, self.right[node], self.left[node])
            go = ~hit & (node != none)
            open_, node = open_[go], node[go]
        found = np.flatnonzero(here != none)
        for side, down, back, limit, sign in ((before, self.left, self.right, low, 1), (behind, self.right, self.left, high, -1)):
            open_ = found[side[found] == none]
            node = down[here[open_]]
            while len(open_):  # the first node below that is within the stretch
                inside = (node != none) & (sign * self.doc[node] > sign * limit[open_])
                side[open_[inside]] = node[inside]
                go = ~inside & (node != none)
                open_, node = open_[go], back[node[go]]
        return tuple(x.reshape(-1, width) for x in (here, before, behind))

    def search(self, items: list[list[int]], k: int, limits: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, documents, scores): of each item, a list of terms, the k best documents and those level with the last;
        only scores of its limit or more are looked for."""
        width = max(1, max((len(x) for x in items), default=1))
        roots = np.full((len(items), width), self.none, np.int32)
        for q, x in enumerate(items):
            roots[q, : len(x)] = self.root[x]
        limit = np.maximum(np.array(limits, np.int64), 1)
        q, low, high = np.arange(len(items)), np.full(len(items), -1, np.int32), np.full(len(items), self.n_docs, np.int32)
        bound = self.impact[roots].sum(1)
        best = [(np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in items]
        while True:
            keep = bound >= limit[q]
            roots, q, low, high, bound = (x[keep] for x in (roots, q, low, high, bound))
            if not len(q):
                break
            order = np.argpartition(-bound, STRETCHES) if len(q) > STRETCHES else np.arange(len(q))
            now, later = order[:STRETCHES], order[STRETCHES:]
            r, i = roots[now], q[now]
            at = self.doc[r[np.arange(len(now)), self.impact[r].argmax(1)]]
            here, before, behind = self.split(r, at, low[now], high[now])
            score = self.impact[here].sum(1)
            self.taken += len(now)
            for x in np.unique(i[good := score >= limit[i]]):
                mine = good & (i == x)
                docs, scores = np.append(best[x][0], at[mine]), np.append(best[x][1], score[mine])
                if len(scores) >= k:
                    limit[x] = max(limit[x], -np.partition(-scores, k - 1)[k - 1])
                    docs, scores = docs[scores >= limit[x]], scores[scores >= limit[x]]
                best[x] = docs, scores
            roots = np.concatenate([roots[later], before, behind])
            bound = np.concatenate([bound[later], self.impact[before].sum(1), self.impact[behind].sum(1)])
            low, high = np.concatenate([low[later], low[now], at]), np.concatenate([high[later], at, high[now]])
            q = np.concatenate([q[later], i, i])
        for x, (docs, scores) in enumerate(best):
            yield x, docs, scores


def _counted(docs: DataFrame, id_col: str, text_col: str, names: dict[bytes, int]) -> DataFrame:
    """(id, n: terms of the text, term and tf: arrays of the terms that items have) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("term", "tf")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n, which, often = [], [], []
                for t in batch.column(1):
                    words = terms(t.as_py())
                    counts = Counter(filter(names.__contains__, words))
                    n.append(len(words))
                    which.append([names[w] for w in counts])
                    often.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _searched(items: list[list[int]], weights: list[int], n_docs: int, n_terms: int, k: int, limits: list[int], schema: T.StructType) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
        term, tf = (rows.column(c).combine_chunks() for c in ("term", "tf"))
        lengths = pc.list_value_length(term).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(rows.num_rows, dtype=np.int64), lengths)
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (term, tf))
        length = 50 + 50 * rows.column("n").to_numpy().astype(np.int64) * n_docs // max(1, n_terms)
        impact = np.array(weights, np.int64)[term] * (1_000_000_000 * tf // (1000 * tf + 20 * length[doc]))
        order = np.argsort(term, kind="stable")
        treaps = Treaps(doc[order], term[order], impact[order], rows.num_rows, len(weights))
        item, place, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(items), ITEMS):
            for x, docs, scores in treaps.search(items[at : at + ITEMS], k, limits[at : at + ITEMS]):
                top = np.lexsort([docs, -scores])[:k]
                item.append(np.full(len(top), at + x))
                place.append(docs[top].astype(np.int64))
                score.append(scores[top])
        ids = rows.column("id").take(pa.array(np.concatenate(place)))
        shard = np.full(len(ids), key[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(shard), pa.array(np.concatenate(item)), ids, pa.array(np.concatenate(score))], names=schema.names)

    return run


def _best(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k best of found for each value of `by`, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_docs: int = SHARD_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents for each row of items: its id, rank (int, from 1), the document's id, score (long).

    A term's weight is the logarithm of its rarity among documents with terms; a document's score adds the weights of the
    item's terms, damped by how often the document has them and by its length, in whole numbers. Documents without a
    common term, null texts among them, aren't ranked; an item without terms has no rows. Of equal scores the smaller id
    comes first, a null id last. Items and documents with like ids are rows of their own. Other columns aren't read. No
    documents or items in: no rows out.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    items = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    out = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        found = _search_block(docs, [(r.item, r.text) for r in mine], k, id_col, text_col, kind, item_kind, shard_docs)
        out = found if out is None else out.unionByName(found)
    names = {"item": item_col, "rank": "rank", "id": id_col, "score": "score"}
    return out.select(*[F.col(c).alias(n) for c, n in names.items()])


def _search_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, kind: T.DataType, item_kind: T.DataType, shard_docs: int) -> DataFrame:
    spark = docs.sparkSession
    sets = [sorted(set(terms(t))) for _, t in items]
    names = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    counted = shared_table(_counted(docs, id_col, text_col, names), "ranked-terms")
    n_docs, n_terms, rows, postings = counted.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.count(F.lit(1)), F.sum(F.size("term"))).first()
    df = {r.t: r.df for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names))]
    asked = [[names[t] for t in s if names[t] in df] for s in sets]

    shards = max(shuffle_partitions(spark), math.ceil(rows / shard_docs), math.ceil((postings or 0) / SHARD_POSTINGS))
    # what the table's files have is dealt out by place, so rows alike are as good as others
    dealt = counted.filter(F.size("term") > 0).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("item_no", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])

    def search(part: DataFrame, limits: list[int]) -> DataFrame:
        run = _searched(asked, weights, n_docs, n_terms or 0, k, limits, schema)
        return shared_table(part.groupBy("shard").applyInArrow(run, schema), "ranked-found")

    ahead = search(dealt.filter(F.col("shard") % AHEAD_1_IN == 0), [1] * len(items))
    last = {r.item_no: r.score for r in _best(ahead, k, ["item_no"]).filter(F.col("rank") == k).collect()}
    found = ahead.unionByName(search(dealt.filter(F.col("shard") % AHEAD_1_IN != 0), [last.get(i, 1) for i in range(len(items))]))
    while shards > FAN_IN:
        shards = math.ceil(shards / FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        found = shared_table(_best(found, k, ["item_no", "shard"]).drop("rank"), "ranked-best")
    numbered = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], T.StructType([T.StructField("no", T.LongType()), T.StructField("item", item_kind)]))
    ranked = _best(found, k, ["item_no"]).join(F.broadcast(numbered), F.col("item_no") == F.col("no"))
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), "id", "score")
