"""Runs of repeated words, found in linear time over an ordered alphabet.

A run is a longest stretch of words that a shift by its smallest period maps onto itself. Its Lyndon roots, by the order
of words or by the reverse order, are the longest Lyndon words that begin where they begin, so both Lyndon tables give a
root of every run. A table is built from left to right: a stack holds the suffixes that no later one is smaller than, and
a new suffix is compared with its top. How far two suffixes agree is kept for each comparison; of the stretch that was
matched farthest to the right, every later comparison inside takes over what its counterpart found, and the next entry of
the stack takes over what its predecessor found, so symbols are matched onwards from the farthest place only. The words
are compared with each other as they are: no ranks, no suffix structure, no hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many periods and so many words.
MIN_EXPONENT, MIN_LENGTH = 4, 6


def lyndon_table(w: list, backwards: bool, min_exponent: int = 2, matched: list[int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """(next smaller suffix of each place, or len(w); how far the two suffixes agree; the places i whose Lyndon word w[i:j]
    agrees so far with what follows that a run of min_exponent periods may begin with it or less than a period before it).

    backwards: by the reverse order of words. The end of the text is smaller than any word in both. matched[0] grows
    by the number of words that were compared and agreed."""
    n = len(w)
    after, agree = [n] * n, [0] * n
    before, agree_before = [-1] * n, [0] * n  # the next entry of the stack below, and how far the two agree
    roots = []
    box = end = shift = 0  # the suffixes at box - shift and box agree up to end, farther right than any other pair
    times = min_exponent - 2
    for r in range(1, n):
        here, i = w[r], r - 1
        if r >= end:
            while i >= 0:  # words that differ at once
                there = w[i]
                if there == here:
                    break
                if (there < here) != backwards:
                    before[r] = i
                    break
                after[i] = r
                i = before[i]
            if i < 0 or there != here:
                continue
        m = 0
        while True:
            known = -1
            if i >= box and r < end:
                known = agree[i - shift] if after[i - shift] == r - shift else agree_before[r - shift] if before[r - shift] == i - shift else -1
            if 0 <= known < end - r:
                m = known
            else:
                if known >= 0:
                    m = max(m, end - r)
                start = m
                while r + m < n and w[i + m] == w[r + m]:
                    m += 1
                if matched is not None:
                    matched[0] += m - start
                if r + m > end:
                    box, end, shift = r, r + m, r - i
            if r + m < n and (w[i + m] < w[r + m]) != backwards:
                before[r], agree_before[r] = i, m
                break
            after[i], agree[i] = r, m
            if m > times * (r - i):
                roots.append(i)
            below = before[i]
            while below >= 0 and agree_before[i] > m:  # agrees with i beyond m, so it compares as i does
                i = below
                after[i], agree[i] = r, m
                if m > times * (r - i):
                    roots.append(i)
                below = before[i]
            if below < 0:
                break
            if agree_before[i] < m:  # differs from i, and so from r, where i is the larger one
                before[r], agree_before[r] = below, agree_before[i]
                break
            i = below
    return after, agree, roots


def find_runs(w: list, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least min_exponent (2 or more) periods and min_length words, in order."""
    found = []
    for backwards in (False, True):
        after, agree, roots = lyndon_table(w, backwards, min_exponent)
        for i in roots:
            j = after[i]
            p = j - i
            if i >= p and after[i - p] == i and agree[i - p] >= p:
                continue  # the root before it is of the same run
            k = 1
            while k <= i and w[i - k] == w[j - k]:
                k += 1
            length = k - 1 + p + agree[i]
            if length >= min_length and length >= min_exponent * p:
                found.append((i - k + 1, length, p))
    found.sort()  # those at the end of the text come from both orders
    return [x for k, x in enumerate(found) if not k or x != found[k - 1]]


def collapse(w: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return w
    gone = bytearray(len(w))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [x for x, g in zip(w, gone, strict=True) if not g]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of docs: its id, n_words (long), runs (array of start, length, period, by start, then period),
    collapsed (the text's kept words, joined by one space).

    A null text has no words: no runs, and an empty collapsed text. Rows alike give rows alike, null ids included. Other
    columns aren't read. A text is worked on whole, in time and memory that grow with it. No rows in: no rows out.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])
    parts = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                counts, every, texts = [], [], []
                for t in batch.column(1):
                    w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                    found = find_runs(w, min_exponent, min_length)
                    counts.append(len(w))
                    every.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in found])
                    texts.append(b" ".join(collapse(w, found)).decode("utf-8", "surrogatepass"))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(every, pa.list_(pa.field("element", parts, False))), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
