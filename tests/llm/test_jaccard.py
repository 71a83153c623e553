"""The n-gram join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stormloom.llm import jaccard, queries

from .conftest import SCHEMA, corpus, sentence
from .test_dedup_quality import WORD, ascii_lower


def brute_sets(text: str | None, words: int = 4) -> frozenset:
    w = WORD.findall(ascii_lower(text or ""))
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_components(rows: list[tuple], words: int = 4, similarity: int = 85) -> list[str]:
    """Rows (id, size, component) by comparing all pairs of different sets."""
    members: dict[frozenset, list] = {}
    for r in rows:
        members.setdefault(brute_sets(r[1], words), []).append(r[0])
    sets, out, seen = [s for s in members if s], [(i, 0, i) for i in members.get(frozenset(), [])], set()
    for s in sets:
        if s in seen:
            continue
        todo, group = [s], []
        seen.add(s)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in sets:
                if y not in seen and 100 * len(x & y) >= similarity * len(x | y):
                    seen.add(y)
                    todo.append(y)
        least = min((i for x in group for i in members[x] if i is not None), default=None)
        out += [(i, len(x), least) for x in group for i in members[x]]
    return sorted(map(str, out))


def families(seed: int = 5) -> list[tuple]:
    """Texts and copies of them with some words changed, around and above the limit, and passages that many share."""
    rng = random.Random(seed)
    rows: list[str | None] = [None, "", " \n", "one", "One", "one two three", "ONE two  three\n", "a b c d", "a b c d e"]
    passage = sentence(rng, 70)
    rows += [f"{sentence(rng, k)} {passage} {sentence(rng, k)}" for k in (0, 1, 2, 3, 4, 6, 9, 30) for _ in range(12)]
    for copies in [5] * 10 + [90]:
        base = sentence(rng, 110 if copies == 90 else rng.randrange(30, 160)).split()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = sentence(rng, 1) + "x"
            rows.append(" ".join(copy))
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("direct", "cell", "rounds", "counted"), [(32, 2048, 3, 4_000_000), (2, 6, 0, 500), (4, 20, 1, 3000)])
def test_by_all_pairs(spark, monkeypatch, direct, cell, rounds, counted):
    """Whole columns; columns of a few sets in several cells, with and without rounds before all pairs meet."""
    monkeypatch.setattr(jaccard, "COUNTED", counted)
    rows = families()
    sets = [brute_sets(r[1]) for r in rows]
    near = [len(x & y) / len(x | y) for k, x in enumerate(sets) for y in sets[:k] if x and y]
    assert sum(0.85 <= x < 0.95 for x in near) > 50 and sum(0.6 < x < 0.85 for x in near) > 50
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), direct_rows=direct, cell_rows=cell, rounds=rounds)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_components(rows)


def test_other_limits_names_and_odd_rows(spark):
    """Nulls in every column, long texts, repeated rows, columns named like the operator's own."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id").withColumnRenamed("n_chars", "n")
    for words, similarity in ((4, 85), (1, 50)):
        got = jaccard.jaccard_components(docs, words=words, similarity=similarity)
        assert sorted(str(tuple(r)) for r in got.collect()) == brute_components(rows, words, similarity)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_op12(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(str(tuple(r)) for r in queries.op12_jaccard_join(spark, sf).collect()) == brute_components(rows)


def test_leading_parts_hold_what_pairs_share():
    """Sets that share the least that they may: among their leading parts they share `level`."""
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n, m = rng.integers(1, 60, 2)
        a = int(jaccard.least_common(np.int64(n), np.int64(m), 85))
        if a <= min(n, m):
            order = rng.permutation(n + m)
            x, y = np.sort(order[:n]), np.sort(order[n - a : n - a + m])
            level = min(jaccard.LEVEL, a)
            assert len(np.intersect1d(x[: n - a + level], y[: m - a + level])) >= level
            assert jaccard.leading(int(n), 85) >= n - a + level or jaccard.leading(int(n), 85) == n


def test_links_of_a_large_group_do_not_grow_with_its_square(spark):
    """120 copies with a few words changed, many similar and many not: links are about as many as sets, not as pairs."""
    rng = random.Random(11)
    base = sentence(rng, 250).split()
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = sentence(rng, 1) + "x"
        rows.append((i, " ".join(copy), "en", "s", 0))
    sets = list({brute_sets(r[1]) for r in rows})
    similar = sum(100 * len(x & y) >= 85 * len(x | y) for k, x in enumerate(sets) for y in sets[:k])
    join = jaccard.JaccardJoin(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 4, 85, rounds=0)
    assert similar > 10 * len(sets)
    assert 0 < join.links().count() <= 4 * len(sets)


def test_sketches_never_differ_in_more_than_sets_do():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m, common = rng.integers(1, 3000), rng.integers(1, 3000), rng.integers(0, 3000)
        every = np.unique(rng.integers(0, 2**63, n + m + common, dtype=np.int64).view(np.uint64))
        rng.shuffle(every)
        x, y = every[: n + common], every[n:]
        a, b = (np.frombuffer(jaccard.sketch(s), np.uint64) for s in (x, y))
        assert jaccard.odd_parts(a[None], b)[0] == jaccard.odd_parts(b[None], a)[0] <= len(np.setxor1d(x, y))
