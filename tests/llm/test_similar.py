from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from stormloom.llm import similar

from .conftest import SCHEMA, sentence
from .test_dedup_quality import WORD, ascii_lower


def brute_set(t: str | None) -> frozenset:
    w = WORD.findall(ascii_lower(t or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_kept(texts: dict[int, str | None]) -> set[int]:
    sets = {i: brute_set(t) for i, t in texts.items()}
    seen, kept = set(), set()
    for start in sorted(sets):
        if start not in seen:
            kept.add(start)
            todo = [start]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += [j for j in sets if j not in seen and jaccard(sets[i], sets[j]) >= 0.8]
    return kept


def families() -> list[tuple]:
    """Texts and copies of them with some words changed, around and above 0.8."""
    rng = random.Random(5)
    rows: list[str | None] = [None, "", "one", "One", "one two three", "ONE two  three\n"]
    for copies in [6] * 12 + [60]:  # the last fills buckets, so both rounds find pairs
        base = sentence(rng, 120 if copies == 60 else rng.randrange(60, 200)).split()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = sentence(rng, 1) + "x"
            rows.append(" ".join(copy))
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_copies_by_brute_force(spark, monkeypatch, cell_rows):
    """Whole nodes; and nodes of a few dozen texts dealt into cells."""
    monkeypatch.setattr(similar, "CELL_ROWS", cell_rows)
    rows = families()
    texts = {r[0]: r[1] for r in rows}
    pairs = [jaccard(brute_set(texts[i]), brute_set(texts[j])) for i in texts for j in texts if i < j]
    assert sum(0.8 <= x < 0.95 for x in pairs) > 20 and sum(0.5 < x < 0.8 for x in pairs) > 20
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == brute_kept(texts)


def test_copies_of_a_real_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert got == brute_kept(texts)
    assert not {1, 177} <= got and not {6, 145} <= got  # 0.83, and 11 and 7 bits of the three-word fingerprint


def test_nothing_and_null_ids(spark, no_docs):
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").count() == 0
    docs = spark.createDataFrame([(None, "a b", "en", "s", 0), (None, "A b", "en", "s", 0), (3, "c", "en", "s", 0), (4, "C", "en", "s", 0)], SCHEMA)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == ["3", "None", "None"]


def test_tables_find_pairs_at_the_limit():
    """The share of pairs at a similarity of 0.8 that meet in no node, at three sizes."""
    rng = np.random.default_rng(0)
    apart = []
    for size in (10, 100):
        for _ in range(500):
            h = rng.integers(0, 1 << 64, size, np.uint64)
            a, b = (similar.wide_fingerprint(np.delete(h, slice(k * size // 10, (k + 1) * size // 10))) for k in (0, 1))
            apart.append([x ^ y for x, y in zip(a, b, strict=True)])
    for n in (50_000, 2_000_000, 10**9):
        tables = similar.block_tables(n)
        missed = sum(x.bit_count() + y.bit_count() > similar.RADIUS or all(x & m or y & k for m, k in tables) for x, y in apart)
        assert missed <= 0.02 * len(apart)


def test_repeated_ids(spark):
    """An id with two texts: each text's group keeps one row; rows alike count once."""
    rows = [(5, "a b c", "en", "s", 0), (5, "d e f", "en", "s", 0), (6, "x y", "en", "s", 0), (7, "A b c", "en", "s", 0), (6, "x y", "en", "s", 0)]
    got = similar.drop_similar_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(5, "a b c"), (5, "d e f"), (6, "x y")]
