"""The replay buffer: what is kept of a site's scans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP_MINUTES = 120
BUFFERED = "site_id string, scan_id long, at_us long, scan_count long, previous_id long, first_us long, last_us long, late boolean"


def retained(scans: DataFrame, minutes: int = KEEP_MINUTES) -> DataFrame:
    """For each scan what a buffer holds just after it: scan_count, previous_id, and the first and last time. Scans
    older than so many minutes before it are out; a site's buffer is its own."""
    seconds = F.unix_timestamp("scan_ts")
    site = Window.partitionBy("site_id").orderBy(seconds)
    held = site.rangeBetween(-60 * minutes, 0)
    rows = Window.partitionBy("site_id").orderBy("scan_ts", "scan_id")
    return scans.select("site_id", "scan_id", "scan_ts", F.count(F.lit(1)).over(held).alias("scan_count"), F.lag("scan_id").over(rows).alias("previous_id"), F.min("scan_ts").over(held).alias("first_ts"), F.max("scan_ts").over(held).alias("last_ts"))


def held_scans(scans: DataFrame, minutes: int = KEEP_MINUTES) -> DataFrame:
    """The scans that each site's buffer holds in the end."""
    newest = scans.groupBy("site_id").agg(F.max("scan_ts").alias("__newest"))
    return scans.join(newest, "site_id").filter(F.col("scan_ts") >= F.col("__newest") - F.expr(f"INTERVAL {minutes} MINUTES")).drop("__newest")


def retained_stream(scans: DataFrame, minutes: int = KEEP_MINUTES, late: str = "10 minutes") -> DataFrame:
    """Number of scans of each site in sliding windows of the buffer's length, over a stream with late rows."""
    return scans.withWatermark("scan_ts", late).groupBy("site_id", F.window("scan_ts", f"{minutes} minutes", "5 minutes")).agg(F.count(F.lit(1)).alias("scan_count"), F.max("scan_ts").alias("last_ts"))


class _Buffer(StatefulProcessor):
    """One site's buffer. A scan's row comes once the watermark has passed its time, as then no earlier one can follow."""

    def __init__(self, minutes: int):
        self.keep_us = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at_us long, scan_id long", "n long")
        self.last = handle.getValueState("last", "at_us long, scan_id long, passed_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late = []
        for batch in rows:
            for at, scan in zip(batch["at_us"].tolist(), batch["scan_id"].tolist(), strict=True):
                due = -(-at // 1000)
                if due <= passed:
                    late.append((key[0], scan, at, None, None, None, None, True))
                    continue
                n = self.held.getValue((at, scan))[0] if self.held.containsKey((at, scan)) else 0
                self.held.updateValue((at, scan), (n + 1,))
                self.handle.registerTimer(due)
        yield _frame(late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() <= last[2]:
            return  # an earlier timer of this watermark has given all that it allows, in one pass
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((*k, n) for k, (n,) in self.held.iterator() if k[0] <= passed * 1000)
        times, total = [at for at, _, _ in held], [0, *accumulate(n for _, _, n in held)]
        before = tuple(last[:2]) if last is not None else None
        out = []
        for at, scan, n in held:
            if before is not None and (at, scan) <= before:
                continue
            first, end = bisect_left(times, at - self.keep_us), bisect_right(times, at)
            for _ in range(n):
                out.append((key[0], scan, at, total[end] - total[first], before[1] if before else None, times[first], at, False))
                before = (at, scan)
        if before is not None:
            self.last.update((*before, passed))
        for at, scan, _ in held:
            if at < passed * 1000 - self.keep_us:
                self.held.removeKey((at, scan))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=[x.split()[0] for x in BUFFERED.split(", ")])
    return found.astype({"scan_count": "Int64", "previous_id": "Int64", "first_us": "Int64", "last_us": "Int64", "scan_id": "int64", "at_us": "int64", "late": "bool", "site_id": "object"})


def buffer_stream(scans: DataFrame, minutes: int = KEEP_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The rows of `retained`, with `late`, over a stream whose scans may come in any order: the buffer is the state of its
    site, a map by time from which scans go when they are too old for any scan that can still come. A scan's row is given
    when the watermark passes its time. A scan that comes after that is kept out of the buffer and gives a row of its own
    with late true and null in place of what the buffer holds, so none is lost without a trace. Rows without a site or a time
    are left out. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    # the time goes on as a number: by its own column Spark would drop late rows before they are seen
    timed = scans.filter("site_id IS NOT NULL AND scan_id IS NOT NULL AND scan_ts IS NOT NULL").withWatermark("scan_ts", late)
    rows = timed.select("site_id", F.col("scan_id").cast("long").alias("scan_id"), F.unix_micros("scan_ts").alias("at_us"))
    found = rows.groupBy("site_id").transformWithStateInPandas(_Buffer(minutes), BUFFERED, "Append", "EventTime")
    times = [F.timestamp_micros(a).alias(b) for a, b in (("first_us", "first_ts"), ("last_us", "last_ts"))]
    return found.select("site_id", "scan_id", F.timestamp_micros("at_us").alias("scan_ts"), "scan_count", "previous_id", *times, "late")
