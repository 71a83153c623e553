"""URL filters: rules on hosts and paths, and for the rest a ratio of two character language models.

One model is of accepted, one of rejected URLs, as the rules decide them: variable-order Markov models of characters
that mix each order's counts with the prediction of the next shorter context. A URL's score is the difference of its
log-likelihoods, per character. The threshold is the one that errs least on labelled URLs that the models didn't count.

Counts are exact: a table of the runs of ORDER + 1 characters, of which the counts of all shorter contexts are sums. What
a character adds to a score depends on its run alone, so the models are evaluated once for each run that URLs have. The
most frequent runs' values are broadcast, the others meet their URLs in a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, ASCII_UPPER, shared_table

#: Characters of context at most, and the weight of the shorter context's prediction, in counts.
ORDER, PRIOR = 4, 4.0
#: Runs of characters whose values are broadcast, 16 bytes each.
FREQUENT = 1 << 18
#: One labelled URL in so many calibrates instead of being counted; places of the histogram of scores, and its range.
CALIBRATE_1_IN = 10
BINS, SPAN = 4000, 8.0
SEED = 9

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def run_codes(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length of each URL; for every character of all URLs the number made of the ORDER bytes before it and its own).
    Contexts reach back over the start into zero bytes."""
    size = np.array([len(u) for u in urls], np.int64)
    data = np.frombuffer(b"".join(b"\0" * ORDER + u for u in urls), np.uint8).astype(np.int64)
    begin = np.cumsum(size + ORDER) - size
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    code = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        code = code << 8 | data[at - k]
    return size, code


def bytes_of(column: pa.Array) -> list[bytes]:
    return [(u or "").encode("utf-8", "surrogatepass") for u in column.to_pylist()]


def count_runs(urls: DataFrame) -> DataFrame:
    """(run, n: in how many places of the column `url`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, n = np.unique(run_codes(bytes_of(batch.column(0)))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(n)], names=["run", "n"])

    return urls.select("url").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def run_values(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """runs with `value`: the log of its last character's probability by the accepted URLs' model less that by the
    rejected ones'. counts: (run, a, b), the places of each run in accepted and rejected URLs."""
    sums = [F.sum(c).alias(c) for c in "ab"]
    p = {c: F.lit(1 / 256) for c in "ab"}
    for k in range(ORDER + 1):
        for kind, code, size in (("both", F.col("run").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)), k + 1), ("context", F.shiftright("run", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)), k)):
            table = counts.groupBy(code.alias("code")).agg(*sums).withColumnsRenamed({"a": f"a_{kind}", "b": f"b_{kind}", "code": f"code_{kind}"})
            table = F.broadcast(table) if size <= 2 else table  # at most 65,536 rows
            runs = runs.withColumn("__code", code).join(table, F.col("__code") == F.col(f"code_{kind}"), "left").drop("__code", f"code_{kind}")
        runs = runs.withColumns({f"p_{c}": (F.coalesce(f"{c}_both", F.lit(0)) + PRIOR * p[c]) / (F.coalesce(f"{c}_context", F.lit(0)) + PRIOR) for c in "ab"})
        runs = runs.drop(*[f"{c}_{kind}" for c in "ab" for kind in ("both", "context")])
        p = {c: F.col(f"p_{c}") for c in "ab"}
    return runs.withColumn("value", F.log(p["a"]) - F.log(p["b"])).drop("p_a", "p_b")


def best_threshold(histogram: np.ndarray) -> float:
    """The middle of the bins between which the balanced error of [accepted, rejected] is least."""
    shares = histogram / np.maximum(histogram.sum(1, keepdims=True), 1)
    below = np.concatenate([[[0.0], [0.0]], np.cumsum(shares, 1)], axis=1)
    error = below[0] + 1 - below[1]  # accepted ones below the threshold, rejected ones from it on
    least = np.flatnonzero(error <= error.min() + 1e-12)
    return -SPAN + 2 * SPAN * float(least[0] + least[-1]) / 2 / BINS


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", frequent: int = FREQUENT) -> DataFrame:
    """pages with host, path, rule (null if none fits), verdict (allow or block), score (double).

    Every URL on which a rule decides is counted in its class's model or calibrates the threshold; repeated URLs count
    each time. The score is that of exact counts of every context, whatever their number: the values of at most
    `frequent` runs and a histogram are all that the driver holds. Without URLs of both classes the method allows all. A
    null URL counts as empty: score 0. A URL is read whole. The list of rules becomes one expression, so it should be
    short. Input columns named like an output are replaced. No rows in: no rows out.
    """
    sc = pages.sparkSession.sparkContext
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    ruled = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), url.alias("url"), host.alias("host"), path.alias("path"))
    ruled = ruled.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("calibrates", F.col("rule").isNotNull() & (F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(CALIBRATE_1_IN)) == 0))
    counted = {c: count_runs(ruled.filter((F.col("rule.verdict") == v) & ~F.col("calibrates"))).withColumnRenamed("n", c) for c, v in (("a", "allow"), ("b", "block"))}
    counts = shared_table(counted["a"].join(counted["b"], "run", "full").na.fill(0, ["a", "b"]), "url-counts")
    values = shared_table(run_values(count_runs(ruled), counts), "url-values")
    often = values.orderBy(F.col("n").desc(), "run").limit(frequent).toArrow()
    order = np.argsort(often["run"].to_numpy())
    model = sc.broadcast((often["run"].to_numpy()[order], often["value"].to_numpy()[order]))
    schema = T.StructType([*ruled.schema.fields, T.StructField("total", T.DoubleType()), T.StructField("rest", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, value = model.value
        for batch in batches:
            size, code = run_codes(bytes_of(batch.column(1)))
            at = np.minimum(np.searchsorted(runs, code), len(runs) - 1)
            known = runs[at] == code if len(runs) else np.zeros(len(code), bool)
            sums = np.concatenate([[0.0], np.cumsum(np.where(known, value[at], 0.0) if len(runs) else np.zeros(len(code)))])
            ends = np.cumsum(size)
            rare = np.concatenate([[0], np.cumsum(~known)])[np.concatenate([[0], ends])]
            rest = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(code[~known]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[ends] - sums[ends - size]), rest, pa.array(size)], names=schema.names)

    scored = shared_table(ruled.mapInArrow(score, schema), "url-scores")
    if values.count() > len(order):  # rare runs bring their values to the URLs that have them
        key = [F.xxhash64("url").alias("k1"), F.xxhash64(F.lit("url"), "url").alias("k2")]
        rest = scored.filter(F.size("rest") > 0).select(*key, "rest").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("rest").alias("run"))
        rest = rest.join(values.select("run", "value"), "run").groupBy("k1", "k2").agg(F.sum("value").alias("more"))
        scored = scored.select("*", *key).join(rest, ["k1", "k2"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
        scored = shared_table(scored.drop("k1", "k2", "more"), "url-scores")
    scored = scored.withColumn("score", F.col("total") / F.greatest("size", F.lit(1)))

    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS)))
    histogram = np.zeros((2, BINS), np.int64)
    for blocked, k, n in scored.filter("calibrates").groupBy((F.col("rule.verdict") == "block").alias("y"), place.alias("k")).count().collect():
        histogram[int(blocked), k] = n
    known = all(counts.agg(F.max(c)).first()[0] for c in "ab")
    threshold = best_threshold(histogram) if known and histogram.any() else (0.0 if known else -np.inf)
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select(*[F.col("page").getField(c).alias(c) for c in pages.columns], "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "score")
