"""Site-relative line frequency: drop the lines that too large a share of a host's pages contain. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: A line on more than this share of its host's pages is boilerplate ...
RATIO = 0.01
#: ... if it is on at least so many pages.
MIN_PAGES = 5
#: Boilerplate lines up to which the whole list is broadcast (about 32 bytes each); beyond it, lines are joined by shuffle.
BROADCAST_LINES = 200_000


def _identity(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def frequent_lines(docs: DataFrame, host_col: str, text_col: str, limit: Callable[[Column], Column], normalise: Callable[[Column], Column] = lambda x: x, floor: float = 0) -> DataFrame:
    """(host, line) of the lines that more of their host's pages have than limit(the host's number of pages). A page
    counts once for each line, however often it has it; lines of white space only are left out. No
    limit is below floor."""
    pages = docs.select(F.col(f"`{host_col}`").alias("host"), F.split(F.col(f"`{text_col}`"), "\n", -1).alias("lines"))
    worded = F.filter("lines", lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.transform(worded, normalise), _identity))).alias("line"))
    with_line = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > floor)
    totals = docs.groupBy(F.col(f"`{host_col}`").alias("t_host")).agg(F.count(F.lit(1)).alias("pages"))
    return with_line.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).filter(F.col("n") > limit(F.col("pages"))).select("host", "line")


def with_frequent(docs: DataFrame, bad: DataFrame, host_col: str, text_col: str, normalise: Callable[[Column], Column] = lambda x: x, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with `__lines`: the text's lines, each with whether it is `frequent`, that is among bad's lines of its host."""
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    lines = F.split(text, "\n", -1)
    if bad.count() <= broadcast_lines:
        per_host = bad.groupBy("host").agg(F.collect_list("line").alias("__bad")).withColumnRenamed("host", "__host")
        marked = docs.join(F.broadcast(per_host), host.eqNullSafe(F.col("__host")), "left")
    else:  # by shuffle: the marks of each page come from its own lines, and meet the page again under its digest
        page = F.sha2(F.concat_ws("\x00", host.isNull().cast("string"), F.coalesce(host.cast("string"), F.lit("")), text.isNull().cast("string"), F.coalesce(text, F.lit(""))), 256)
        paged = docs.withColumn("__page", page)
        own = paged.select("__page", host.alias("host"), F.explode(F.array_distinct(F.transform(F.transform(lines, normalise), _identity))).alias("line"))
        same = own["host"].eqNullSafe(bad["host"]) & (own["line"] == bad["line"])
        marks = own.join(bad, same, "left_semi").groupBy("__page").agg(F.collect_set("line").alias("__bad"))
        marked = paged.join(marks, "__page", "left")
    keyed = F.transform(F.transform(lines, lambda x: F.struct(x.alias("line"), normalise(x).alias("norm"))), lambda x: F.struct(x["line"].alias("line"), _identity(x["norm"]).alias("key")))
    marks = F.transform(keyed, lambda x: F.struct(x["line"].alias("line"), F.coalesce(F.array_contains(F.col("__bad"), x["key"]), F.lit(False)).alias("frequent")))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], marks.alias("__lines"))


def site_line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the boilerplate lines taken out of the text, and n_lines, n_dropped (long).

    Null hosts are one host. A null text has no lines and stays null; its row counts as a page. A text whose lines all
    go becomes empty; the row stays. A host of n pages with m lines each has m / ratio such lines at most. Rows with equal ids are independent pages. Input columns named n_lines or
    n_dropped are replaced. No rows in: no rows out.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.col(f"`{text_col}`")

    def limit(pages: Column) -> Column:
        return F.greatest(ratio * pages, F.lit(min_pages - 1))

    bad = shared_table(frequent_lines(docs, host_col, text_col, limit, floor=min_pages - 1), "boilerplate")
    marked = with_frequent(docs, bad, host_col, text_col, broadcast_lines=broadcast_lines)
    kept = F.transform(F.filter("__lines", lambda x: ~x["frequent"]), lambda x: x["line"])
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {text_col: F.when(text.isNotNull(), F.array_join(kept, "\n"))}
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size("__lines"))
    dropped = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter("__lines", lambda x: x["frequent"])))
    return marked.select(*[v.alias(c) for c, v in columns.items()], n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
