"""Runs against brute force: every period is tried, and every stretch that keeps it."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stormloom.llm import queries, runs

from .conftest import SCHEMA, corpus
from .test_dedup_quality import WORD


def brute_runs(w: list, min_exponent: int, min_length: int) -> list[tuple[int, int, int]]:
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                best.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


@given(st.lists(st.lists(st.integers(0, 2), max_size=7).flatmap(lambda x: st.integers(1, 7).map(lambda k: x * k)), max_size=6), st.sampled_from([2, 3, 4]), st.sampled_from([1, 6]))
@settings(max_examples=400, deadline=None)
def test_runs_of_short_words(parts, min_exponent, min_length):
    w = [x for p in parts for x in p]
    assert runs.find_runs(w, min_exponent, min_length) == brute_runs(w, min_exponent, min_length)


@given(st.lists(st.integers(0, 2), max_size=40), st.booleans())
@settings(max_examples=300, deadline=None)
def test_lyndon_tables(w, backwards):
    """The next smaller suffix, the end counting as smallest, and how far the two agree."""
    suffixes = [[-x if backwards else x for x in w[i:]] for i in range(len(w))]
    after, agree, _ = runs.lyndon_table(w, backwards)
    for i, s in enumerate(suffixes):
        j = next((j for j in range(i + 1, len(w)) if suffixes[j] < s), len(w))
        common = 0
        while j + common < len(w) and w[i + common] == w[j + common]:
            common += 1
        assert (after[i], agree[i]) == (j, common)


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("w", [[0] * 20_000, [0, 1] * 10_000, fibonacci(20_000), [bin(i).count("1") & 1 for i in range(20_000)], [x for k in range(190, 0, -1) for x in [0] * k + [1]], [random.Random(3).randrange(2) for _ in range(500)] * 40], ids=["one", "two", "fibonacci", "thue", "falling", "period"])
def test_matching_is_linear(w):
    """Words that are compared and agree: no more than the text has, whatever repeats."""
    for backwards in (False, True):
        matched = [0]
        runs.lyndon_table(w, backwards, matched=matched)
        assert matched[0] <= len(w)


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    w = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w, 4, 6)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    s, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return doc_id, len(found), s, length, q, q and 1000 * length // q, digest(listed), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_op11(spark, tmp_path):
    """The registered query over nulls, empty and long texts, runs in runs, repeated rows and a table without rows."""
    rows = corpus()
    rows += [(1000, "a " * 5000, None, None, 0), (1001, "x y x y x y x y z a a a a a a a", "", "", 0), (1002, "b a b a b a a a a a a a b", "", "", 0), (1003, "a a a a a", "", "", 0), (1004, "k k é é é é é é\x00 é", "", "", 0)]
    rows += [(i, "p q r " * (i % 9) + f"w{i} " + "a b a b a a b a b a " * (i % 6), "", "", 0) for i in range(2000, 2060)] + [(2000, None, "", "", 0), (2001, "u", "", "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(str(brute_row(r[0], r[1])) for r in rows)
    assert sum(r[1] > 0 for r in got) > 40 and max(r[1] for r in got) > 2
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_runs(spark, f"{tmp_path}/none").count() == 0


def test_other_columns_and_names(spark):
    rows = [("k1", "a b a b a b a b", 1, "x"), (None, None, 2, "y")]
    docs = spark.createDataFrame(rows, "runs string, text string, n_words int, collapsed string")
    got = sorted(map(str, (tuple(r) for r in runs.word_runs(docs.withColumnRenamed("runs", "start"), id_col="start").select("start", "n_words", "runs", "collapsed").collect())))
    assert got == sorted([str(("k1", 8, [spark.createDataFrame([(0, 8, 2)], "start long, length long, period long").first()], "a b")), str((None, 0, [], ""))])
    with pytest.raises(ValueError):
        runs.word_runs(docs, min_exponent=1)
