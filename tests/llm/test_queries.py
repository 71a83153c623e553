"""The registered queries, as they are called, against brute force over whole small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stormloom.llm import queries, urls

from .test_dedup_quality import brute_fingerprint, reachable
from .test_urls_toxicity import brute_rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def test_op1(spark, sf, texts, ids):
    got = queries.op1_token_counts(spark, sf)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i, len((t or "").encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in texts.items())
    assert sorted(tuple(r)[:4] for r in got.collect()) == want


def test_op2(spark, sf, texts):
    rows = queries.op2_sharding(spark, sf).collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op5(spark, sf, texts):
    rows = queries.op5_mixing(spark, sf).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(WORD.findall(t or "")) for i, t in texts.items()} and len(rows) == len(texts)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, queries.op5_mixing(spark, sf).collect()))


def test_op6(spark, sf, ids):
    rows = queries.op6_packing(spark, sf).collect()
    want = []
    for i, x in ids.items():
        data = np.array([*x, 1], "<u4")
        want += [(i, k // 4096, k, len(data[k : k + 4096]), zlib.crc32(data[k : k + 4096].tobytes())) for k in range(0, len(data), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= sum(r.length for r in rows) // 4096 + 2


def test_op8(spark, sf, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = reachable(np.array(sorted(set(fps.values())), np.uint64))
    least: dict[int, int] = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    got = sorted(tuple(r) for r in queries.op8_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted((i, f"{f:016x}", least[root[f]]) for i, f in fps.items())


def test_op9(spark, sf):
    """Hosts, paths and rules; scores by counting in dictionaries; one threshold that separates the method's verdicts."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    rows = {r.page_id: r for r in queries.op9_url_filter(spark, sf).collect()}
    assert len(rows) == len(pages)
    ruled = {p.page_id: brute_rule(p.url) for p in pages}
    held = {r.page_id for r in spark.createDataFrame([(p.page_id, p.url) for p in pages], "page_id long, url string").filter(f"pmod(xxhash64({urls.SEED}, url), {urls.CALIBRATE_1_IN}) = 0").collect()}
    counts = ({}, {})
    padded = lambda u: b"\0" * urls.ORDER + (u or "").encode()
    for p in pages:
        if (v := ruled[p.page_id][3]) and p.page_id not in held:
            w, c = padded(p.url), counts[v == "block"]
            for i in range(urls.ORDER, len(w)):
                for k in range(urls.ORDER + 1):
                    for key in ((k, w[i - k : i]), (k, w[i - k : i + 1], 1)):
                        c[key] = c.get(key, 0) + 1
    above, below = [], []
    for p in pages:
        r, (host, path, rule, verdict) = rows[p.page_id], ruled[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
        w, total = padded(p.url), 0.0
        for i in range(urls.ORDER, len(w)):
            probability = [1 / 256, 1 / 256]
            for k in range(urls.ORDER + 1):
                for y in (0, 1):
                    n, b = counts[y].get((k, w[i - k : i]), 0), counts[y].get((k, w[i - k : i + 1], 1), 0)
                    probability[y] = (b + urls.PRIOR * probability[y]) / (n + urls.PRIOR)
            total += np.log(probability[0]) - np.log(probability[1])
        assert abs(r.score - total / max(1, len(w) - urls.ORDER)) < 1e-9
        if verdict is None:
            (above if r.verdict == "allow" else below).append(r.score)
    assert min(above, default=np.inf) >= max(below, default=-np.inf)


def test_op10(spark, sf, texts):
    rows = queries.op10_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_op10_on_held_out_labels(spark):
    """Accuracy on the fifth of the labels that training never sees."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9
