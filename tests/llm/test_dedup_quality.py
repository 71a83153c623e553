from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stormloom.llm import exact_dedup, line_dedup, quality, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("how", [{}, {"capacity": 4}, {"hash_of": lambda c: F.length(c) % 7}, {"hash_of": lambda c: F.lit(5)}, {"hash_of": lambda c: F.xxhash64(c) % 9, "capacity": 1}])
def test_exact_dedup(docs, how):
    groups = defaultdict(list)
    for d in docs.collect():
        groups[ascii_lower(d.text or "")].append(d.doc_id)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_dedup(docs.withColumn("kept", F.lit("clash")).withColumn("key", F.lit("clash")).select("doc_id", "text", "kept", "lang"), **how)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got.collect())


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_carries_columns(docs):
    got = exact_dedup.exact_dedup(docs.withColumn("a.b", F.col("lang")))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got.collect()) == sorted(str((r.doc_id, r.text, r.source)) for r in docs.collect())
    assert exact_dedup.exact_dedup(docs, carried=[]).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_rows_are_found_through_the_directory(docs, monkeypatch):
    """Rows whose prefix the directory lacks find no entry."""
    build = exact_dedup.build_directory

    def wrong(keys, *args):
        directory, depth, n = build(keys, *args)
        return directory.filter("bucket % 2 = 0"), depth, n

    assert exact_dedup.exact_dedup(docs, capacity=4).count() == docs.count()
    monkeypatch.setattr(exact_dedup, "build_directory", wrong)
    assert 0 < exact_dedup.exact_dedup(docs, capacity=4).count() < docs.count()


def test_directory_covers_every_key_once():
    histogram = {0: 50, 1: 3, 9: 7, 15: 900}
    buckets = exact_dedup.split_buckets(histogram, 4, 20)
    cover = [q for p, d in buckets for q in range(p << (4 - d), (p + 1) << (4 - d))]
    assert sorted(cover) == list(range(16))
    for p, d in buckets:
        n = sum(c for q, c in histogram.items() if q >> (4 - d) == p)
        assert n <= 20 or d == 4


def lines_of(docs):
    pages, have = Counter(), defaultdict(set)
    rows = [(k, d.doc_id, d.text, d.source) for k, d in enumerate(docs.collect())]
    for k, _, t, s in rows:
        pages[s] += 1
        for x in (t or "").split("\n"):
            if WORD.search(x):
                have[s, x].add(k)
    return rows, pages, have


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_site_line_dedup(docs, no_docs, broadcast_lines):
    rows, pages, have = lines_of(docs)
    want = []
    for _, i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        bad = [len(have[s, x]) >= 5 and len(have[s, x]) > 0.1 * pages[s] for x in lines]
        want.append((i, None if t is None else "\n".join(x for x, b in zip(lines, bad, strict=True) if not b), len(lines), sum(bad)))
    assert any(w[3] for w in want)
    got = line_dedup.site_line_dedup(docs.withColumn("n_dropped", F.lit("clash")).withColumnRenamed("lang", "host"), ratio=0.1, broadcast_lines=broadcast_lines).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got)
    assert line_dedup.site_line_dedup(no_docs).count() == 0


def brute_counts(t: str) -> tuple:
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_text_counts():
    for t in ["", "a b", "a b c a b c", "a a a a a", "x y z q x y z x y z", "l\nl\n \nl2\r\nl2\r\n", "é#漢 *\x0b|\x1c\x85", "a b a b a b", "p q r s p q r"]:
        assert quality.text_counts(t) == brute_counts(t), t
    assert quality.text_counts(None) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_quality_rules(docs, no_docs, broadcast_lines):
    rows, pages, have = lines_of(docs)
    norm = defaultdict(set)
    key = lambda x: " ".join(WORD.findall(x.lower()))
    for (s, x), ks in have.items():
        norm[s, key(x)] |= ks
    want = []
    for _, i, t, s in rows:
        c = brute_counts(t or "")
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if len(norm.get((s, key(x)), ())) > max(8, 0.01 * pages[s]))
        failed = c[0] < 50 or 2 * c[4] > c[0]
        want.append((i, *c, gone, failed, not failed and 100 * (c[0] - gone) >= 30 * c[0]))
    assert any(w[6] for w in want) and any(w[8] for w in want)
    got = quality.quality_rules(docs, max_docs=8, broadcast_lines=broadcast_lines).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert quality.quality_rules(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op3_quality", "op4_exact_dedup", "op7_line_dedup"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(columns).collect())


def brute_fingerprint(t: str | None) -> int:
    w = WORD.findall(ascii_lower(t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    for t in [None, "", " ", "One", "a B", "a\x0bb c", *(d.text for d in docs.collect())]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def cloud(seed: int, centres: int, each: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(centres):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(each):
            y = x
            for _ in range(int(rng.integers(1, 6))):
                y ^= 1 << int(rng.integers(64))
            out.add(y)
            if rng.random() < 0.3:
                x = y
    return np.array(sorted(out), np.uint64)


def test_gray_index_finds_all_links():
    assert sorted(range(16), key=lambda g: int(simhash.gray_rank(np.array([g], np.uint64))[0])) == [k ^ (k >> 1) for k in range(16)]
    for seed in range(4):
        fps = cloud(seed, 12, 40)
        index = simhash.GrayIndex(fps[:, None])
        got = {tuple(sorted((int(index.fps[i, 0]), int(index.fps[j, 0])))) for a, b in index.links(3) for i, j in zip(a, b, strict=True)}
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
        assert got == {(int(fps[x]), int(fps[y])) for x, y in zip(i, j, strict=True)}


def reachable(fps: np.ndarray) -> dict[int, int]:
    root = list(range(len(fps)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            m = min(root[j] for j in np.flatnonzero(near[i]))
            if m < root[i]:
                root[i], changed = m, True
    return {int(f): r for f, r in zip(fps, root, strict=True)}


@pytest.mark.parametrize("node_rows", [2048, 30])
def test_components_of_fingerprints(spark, node_rows):
    fps = cloud(7, 8, 60)
    want = reachable(fps)
    nodes = spark.createDataFrame([(int(x) - (1 << 64 if int(x) >> 63 else 0),) for x in fps], "fp long")
    links = simhash.near_links(nodes, 3, node_rows)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(links).collect()}
    groups: dict[int, set] = defaultdict(set)
    for f in want:
        groups[roots.get(f, f)].add(f)
    expected: dict[int, set] = defaultdict(set)
    for f, r in want.items():
        expected[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


def test_near_duplicates(docs, no_docs):
    rows = docs.collect()
    fps = np.array(sorted({brute_fingerprint(d.text) for d in rows}), np.uint64)
    root = reachable(fps)
    least: dict[int, int] = {}
    for d in rows:
        if d.doc_id is not None:
            r = root[brute_fingerprint(d.text)]
            least[r] = min(least.get(r, d.doc_id), d.doc_id)
    want = [(d.doc_id, brute_fingerprint(d.text), least.get(root[brute_fingerprint(d.text)])) for d in rows]
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash")).withColumnRenamed("lang", "component_id")).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*set(least.values()), *(i for i, _, c in want if c is None)]))


def test_quality_production_limits(spark):
    """A line in more than 1 % of a host's documents and more than 5 is flagged and depletes its documents."""
    shared = " ".join(f"legal{k}" for k in range(80))
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = []
    for host, pages, have in (("big", 1000, 11), ("big2", 1000, 10), ("small", 20, 6), ("small2", 20, 5)):
        rows += [(f"{host}{'+' if i < have else '-'}{i}", f"{shared}\n{own(i, 20)}" if i < have else own(i, 60), host) for i in range(pages)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    seen = {(r.doc_id.split("+")[0], r.n_frequent_words, r.base_failed, r.kept) for r in got if "+" in r.doc_id}
    assert seen == {("big", 80, False, False), ("big2", 0, False, True), ("small", 80, False, False), ("small2", 0, False, True)}
    assert all(r.kept for r in got if "-" in r.doc_id)


def test_lines_on_one_page(spark):
    docs = spark.createDataFrame([(1, "a\nb", "h"), (2, "a", "h")], "doc_id long, text string, source string")
    got = line_dedup.site_line_dedup(docs, ratio=0.1, min_pages=1).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == [(1, "", 2), (2, "", 1)]
    assert {r.doc_id: r.n_frequent_words for r in quality.quality_rules(docs, max_docs=0).collect()} == {1: 2, 2: 1}


def test_the_line_limit_rejects_documents(spark):
    """With the registered limits, some documents that pass the other rules lose too much to frequent lines."""
    rows = queries.op3_quality(spark, "/root/testdata/sf0.01").collect()
    lost = [r for r in rows if not r.base_failed and not r.kept]
    assert lost and all(100 * (r.n_words - r.n_frequent_words) < quality.MIN_LEFT * r.n_words for r in lost)
    assert sum(r.kept for r in rows) > 0.8 * sum(not r.base_failed for r in rows)
