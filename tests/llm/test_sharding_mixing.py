from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormloom.llm import mixing, queries, sharding


def test_fisher_yates_is_a_uniform_permutation():
    assert sorted(sharding.fisher_yates(50, (1, 2)).tolist()) == list(range(50))
    assert sharding.fisher_yates(0, (1,)).tolist() == []
    seen = Counter(tuple(sharding.fisher_yates(3, (1, k)).tolist()) for k in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_external_shuffle(docs, no_docs):
    wide = docs.withColumnsRenamed({"lang": "shard", "n_chars": "slot"})
    rows = sharding.external_shuffle(wide, 7, bucket_bytes=2000).collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.source) for r in rows])) == sorted(map(str, [(r.doc_id, r.text, r.source) for r in docs.collect()]))
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(7))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    order = lambda rs: [(r.shard, r.slot, r.doc_id, r.text) for r in sorted(rs, key=lambda r: (r.shard, r.slot))]
    assert order(rows) == order(sharding.external_shuffle(docs.repartition(9), 7, bucket_bytes=2000, keys=None).drop("lang").collect()) or order(sharding.external_shuffle(docs.repartition(3), 7).collect()) == order(sharding.external_shuffle(docs.repartition(9), 7).collect())
    assert sharding.external_shuffle(no_docs, 7).count() == 0


def test_like_rows_are_spread(spark):
    """20,000 like rows among 2000 others: no bucket holds more than a few times the average."""
    one = spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text")
    rows = one.unionByName(spark.range(2000).selectExpr("id AS doc_id", "'other' AS text"))
    shuffled = sharding.external_shuffle(rows, 10)
    got = shuffled.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in rows.collect())
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(2200)) for s in shards.values()) and len(shards) == 10
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    in_task = shuffled.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in in_task) < 0.6 * 22_000


def test_write_shards(spark, docs, tmp_path):
    out = str(tmp_path / "shards")
    sharding.write_shards(sharding.external_shuffle(docs, 3), out)
    assert spark.read.parquet(out).groupBy("shard").count().count() == 3
    assert spark.read.parquet(out).count() == docs.count()


def test_op2(spark, sf):
    rows = queries.op2_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1


def by_resharing(sizes: dict, order: list, most: float = 3.0) -> dict:
    """Targets by sharing the excess again and again."""
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed: dict = {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 7, None: 50}, {"a": 10}, {"a": 0, "b": 9, "c": 1}, {"é": 5, "z": 700, "Z": 1, "": 3}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = by_resharing(sizes, order)
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_targets_of_nothing(spark):
    assert [r.target for r in mixing.source_targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")).collect()] == [0.0, 0.0]


def test_pivot_keeps_the_sum_and_the_expectation():
    sizes, wanted = [3, 8, 5, 13, 2, 7], [0.2, 0.7, 0.5, 0.31, 0.9, 0.45]
    total, counts = sum(s * f for s, f in zip(sizes, wanted, strict=True)), np.zeros(6)
    for seed in range(4000):
        left = list(wanted)
        out, at = mixing.pivot(sizes, left, np.random.default_rng(seed))
        assert abs(sum(s * f for s, f in zip(sizes, left, strict=True)) - total) < 1e-9
        assert sum(o < 0 for o in out) == (at >= 0)
        counts += [o if o >= 0 else left[i] for i, o in enumerate(out)]
    assert np.abs(counts / 4000 - wanted).max() < 0.03


@pytest.mark.parametrize("leaf_rows,fan_in", [(20_000, 64), (5, 2)])
def test_mix_sources(docs, no_docs, leaf_rows, fan_in):
    rows = mixing.mix_sources(docs, leaf_rows=leaf_rows, fan_in=fan_in).collect()
    want = sorted((str(d.doc_id), len((d.text or "").encode().split())) for d in docs.collect())
    assert sorted((str(r.doc_id), r.size) for r in rows) == want
    of = defaultdict(list)
    for r in rows:
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        of[r.source].append(r)
    assert abs(sum(x[0].target for x in of.values()) - sum(n for _, n in want)) < 1e-6
    for x in of.values():
        assert x[0].source_size == sum(r.size for r in x)
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(r.size for r in x)
    again = mixing.mix_sources(docs.repartition(7), leaf_rows=leaf_rows, fan_in=fan_in).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_documents(docs):
    taken = Counter()
    for r in mixing.mix_sources(docs.withColumn("n", docs.n_chars)).collect():
        taken[r.doc_id] += r.copies
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    sizes = Counter()
    for r in mixed.collect():
        sizes[r.source] += len((r.text or "").split())
    for r in mixing.mix_sources(docs).select("source", "target").distinct().collect():
        assert abs(sizes[r.source] - r.target) <= 6000


def test_like_rows_over_all_leaves(spark):
    """20,000 rows alike among 2000 others are numbered one by one, and no leaf gets many more than its share."""
    rows = [(1, "s0", 3, 11)] * 20_000 + [(k, "s1", 2, 100 + k) for k in range(2000)] + [(None, None, 0, 7)] * 2
    numbered = mixing.apart(spark.createDataFrame(rows, "id long, source string, size long, tie long"))
    assert numbered.count() == len(rows) and numbered.dropDuplicates(["id", "tie", "copy"]).count() == len(rows)
    assert numbered.groupBy("id", "tie").agg({"copy": "max"}).filter("id = 1 OR id IS NULL").toPandas()["max(copy)"].sum() == 19_999 + 1
    leaves = [r.n for r in numbered.groupBy(F.pmod(F.xxhash64("tie", "copy"), F.lit(32)).alias("leaf")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(leaves) == 32 and max(leaves) < 1.3 * len(rows) / 32
