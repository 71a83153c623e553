"""Ranked search against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stormloom.llm import queries, ranked

from .conftest import SCHEMA, corpus
from .test_dedup_quality import ascii_lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(rows: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    docs = [(r[0], Counter(TERM.findall(ascii_lower(r[1] or "")))) for r in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in docs:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(ascii_lower(text or ""))) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


ITEMS = [(0, "ka lo miter"), (1, None), (2, "??"), (3, "kalo KALO sun vor-el ash,ing po ka"), (3, "lo lo mi"), (None, "漢字 ünïcode don't ka"), (4, "nowhere"), (5, "ka " * 400)]


@pytest.mark.parametrize(("k", "shard_docs", "item_bytes", "stretches"), [(50, 8192, 1 << 20, 4096), (3, 2, 64, 4), (1, 20, 1 << 20, 1)])
def test_by_scores_of_all(spark, monkeypatch, k, shard_docs, item_bytes, stretches):
    """Nulls, empty and long texts, ties, repeated rows, and items alike; shards in two levels, items in blocks."""
    monkeypatch.setattr(ranked, "STRETCHES", stretches)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "score").withColumnRenamed("source", "rank")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.ranked_search(docs, items, k=k, shard_docs=shard_docs, item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_ranks(rows, ITEMS, k)


def test_op13(spark, sf, tmp_path):
    rows, items = (list(map(tuple, spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect())) for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = queries.op13_ranked_search(spark, sf)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_ranks(rows, items, 50)
    for name, kept in (("docs", 0), ("items", 1)):
        spark.createDataFrame(rows[:kept] if name == "docs" else rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([] if name == "items" else items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert queries.op13_ranked_search(spark, f"{tmp_path}/items").count() == 0
    assert sorted(str(tuple(r)) for r in queries.op13_ranked_search(spark, f"{tmp_path}/docs").collect()) == []


def test_traversal_drops_stretches():
    """Rare terms decide, so most documents are never taken out; results are those of all scores."""
    rng = np.random.default_rng(4)
    n_docs, n_terms = 5000, 12
    doc, term = np.nonzero(rng.random((n_docs, n_terms)) < np.geomspace(0.5, 0.01, n_terms))
    impact = (rng.integers(1, 20, len(doc)) * np.geomspace(10, 5000, n_terms).astype(np.int64)[term]).astype(np.int64)
    order = np.lexsort([doc, term])
    treaps = ranked.Treaps(doc[order], term[order], impact[order], n_docs, n_terms)
    items = [[0, 3, 9, 11], [1, 2], [5], []]
    for x, docs, scores in treaps.search(items, 10, [0] * 4):
        full = np.bincount(doc, np.where(np.isin(term, items[x]), impact, 0), n_docs).astype(np.int64)
        want = np.lexsort([np.arange(n_docs), -full])[:10]
        top = np.lexsort([docs, -scores])[:10]
        assert list(zip(docs[top], scores[top], strict=True)) == [(d, full[d]) for d in want if full[d]]
    assert treaps.taken < n_docs / 2


def test_treaps_are_heaps_in_order():
    rng = random.Random(2)
    for n in (0, 1, 2, 50):
        impact = np.array([rng.randrange(6) for _ in range(n)], np.int64)
        root, left, right = ranked.build_treaps(np.zeros(n, np.int64), impact, 1)

        def walk(i, n=n, impact=impact, left=left, right=right):
            if i == n:
                return []
            assert all(c == n or impact[c] <= impact[i] for c in (left[i], right[i]))
            return [*walk(left[i]), i, *walk(right[i])]

        assert walk(root[0]) == list(range(n))
