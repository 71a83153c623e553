from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stormloom.llm import queries

from .test_similar import brute_kept


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    """The rows that go into each stage and come out of it, with columns that clash with the operators' own."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("n_lines", F.lit("x"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_return_the_columns_of_documents(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, (before, after) in results.items():
        if name != "packing":
            assert after.columns == before.columns
            assert after.filter("score <> 'mine' OR n_lines <> 'x'").count() == 0


def test_toxic_documents_go(spark, sf, results):
    before, after = results["toxicity"]
    rejected = {r.doc_id for r in queries.op10_toxicity(spark, sf).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - rejected


def test_boilerplate_lines_go(results):
    before, after = results["line_dedup"]
    old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    pages, have = defaultdict(int), defaultdict(int)
    for r in old.values():
        pages[r.source] += 1
        for x in set(r.text.split("\n")):
            have[r.source, x] += bool(x.strip(" \t\n\v\f\r"))
    for i, r in old.items():
        lines = [x for x in r.text.split("\n") if not (have[r.source, x] >= 5 and have[r.source, x] > 0.01 * pages[r.source])]
        assert new[i].text == "\n".join(lines) and new[i].n_chars == len(new[i].text)


def test_one_of_each_group_stays(results):
    """Groups of five-word shingles at 0.8, by comparing all pairs."""
    before, after = results["near_dedup"]
    kept = [r.doc_id for r in after.collect()]
    assert sorted(kept) == sorted(brute_kept({r.doc_id: r.text for r in before.collect()}))


def test_mix_is_near_its_targets(results):
    before, after = results["mixing"]
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"))).alias("n")).collect()}
    old, new = size(before), size(after)
    assert 0.9 * sum(old.values()) < sum(new.values()) < 1.1 * sum(old.values())
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    copies = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 < copies <= 3


def test_sequences_hold_all_pieces(results):
    before, after = results["packing"]
    rows = after.collect()
    assert sum(r.piece == 0 for r in rows) == before.count()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096


def test_run_is_the_stages(spark, sf, results):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert zlib.crc32(b"") == 0 and docs.count()
    assert corpus_pipeline.run(spark, sf).count() == results["packing"][1].count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf, docs, no_docs, name):
    """Nulls in every column, empty and very long texts, copies, repeated rows; and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, no_docs, sf).count() == 0
    before, after = docs.collect(), stage(spark, docs, sf).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    old, new = Counter(map(key, before)), Counter(map(key, after)) if name != "packing" else None
    if name == "toxicity":
        assert all(new[k] == old[k] for k in new) and ("161", "None") in new
    elif name == "line_dedup":
        assert Counter(str(r.doc_id) for r in after) == Counter(str(r.doc_id) for r in before)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    elif name == "near_dedup":
        assert all(n == 1 for n in new.values()) and set(new) <= set(old)
        # of all rows without words the smallest id; the row of null id is alone in its group
        assert [k for k in new if not k[1].strip() or k[1] == "None"] == [("161", "None")] and any(k[0] == "None" for k in new)
    elif name == "mixing":
        assert set(new) <= set(old) and all(n <= 3 * old[k] for k, n in new.items())
    else:
        assert sum(r.piece == 0 for r in after) == len(before)
        assert Counter(str(r.doc_id) for r in after if r.piece == 0) == Counter(str(r.doc_id) for r in before)
