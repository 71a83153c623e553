"""Listings of scan files: by day, latest, nearest in time, cached, and windows of them. A listing is a table of
(site_id, filename); a file's time is in its name."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_timestamp(filename: Column | str) -> Column:
    """Null if the 15 characters before _V aren't a time."""
    name = F.col(filename) if isinstance(filename, str) else filename
    return F.try_to_timestamp(F.substring(F.substring_index(name, "_V", 1), -15, 15), F.lit("yyyyMMdd_HHmmss"))


def cache_path(root: str, site_id: Column | str = "site_id", filename: Column | str = "filename") -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), site_id, filename)


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """(site_id, filename, path) of the files under root/<site>/; file contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("site_id"), F.element_at(parts, -1).alias("filename"), "path")


def _of_day(files: DataFrame, site_id: str, day: Column) -> DataFrame:
    dated = files.withColumn("scan_ts", scan_timestamp("filename"))
    return dated.filter((F.col("site_id") == site_id) & ~F.col("filename").endswith("_MDM") & (F.to_date("scan_ts") == day))


def scans_of_day(files: DataFrame, site_id: str, day: str) -> DataFrame:
    """Volume scans of a site on a day (YYYY-MM-DD), with scan_ts; metadata files (_MDM) are left out."""
    return _of_day(files, site_id, F.lit(day).cast("date"))


def latest_scans(files: DataFrame, site_id: str, today: str) -> DataFrame:
    """Those of today, or of the day before if there are none today."""
    two = scans_of_day(files, site_id, today).unionByName(_of_day(files, site_id, F.date_sub(F.lit(today).cast("date"), 1)))
    newest = two.agg(F.max(F.to_date("scan_ts")).alias("__day"))
    return two.join(F.broadcast(newest), F.to_date("scan_ts") == F.col("__day")).drop("__day")


def nearest_scans(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (request_id, site_id, dt) with the filename of the same site and day that is nearest in time, the first
    by name on a tie. A request without files on its day has null. Requests and files of a site and day are sorted by
    time once, and each request looks at the last file before it and the first one after."""
    volumes = files.filter(~F.col("filename").endswith("_MDM")).withColumn("scan_ts", scan_timestamp("filename")).filter("scan_ts IS NOT NULL")
    volumes = volumes.groupBy("site_id", F.to_date("scan_ts").alias("day"), F.unix_timestamp("scan_ts").alias("at")).agg(F.min("filename").alias("filename"))
    asked = requests.select("request_id", "site_id", "dt", F.to_date("dt").alias("day"), F.unix_timestamp("dt").alias("at"), F.lit(None).cast("string").alias("filename"))
    both = asked.unionByName(volumes, allowMissingColumns=True).withColumn("file", F.when(F.col("filename").isNotNull(), F.struct("at", "filename")))
    day = Window.partitionBy("site_id", "day")  # rows of one second are peers; a frame that ends with the day would be read anew for each row, so the day is read both ways
    sides = [F.last("file", ignorenulls=True).over(day.orderBy(way).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for way in (F.asc("at"), F.desc("at"))]
    off = [F.when(f.isNotNull(), F.struct(F.abs(f["at"] - F.col("at")).alias("off"), f["filename"].alias("filename"))) for f in (F.col("before"), F.col("after"))]
    found = both.withColumns({"before": sides[0], "after": sides[1]}).filter("filename IS NULL").withColumn("best", F.least(*off))
    return found.select("request_id", "site_id", "dt", F.col("best.filename").alias("filename"), F.col("best.off").cast("long").alias("seconds_off"))


def fetch_scan(files: DataFrame, site_id: str, dt: str | None = None, today: str | None = None) -> str:
    """The file nearest to a time, or the last of the latest as of today (by default the date in UTC); RuntimeError if
    there is none. The bytes stay where they are: a shared file store needs no download."""
    if dt is None:
        row = latest_scans(files, site_id, today or datetime.now(UTC).date().isoformat()).agg(F.max("filename")).first()[0]
    else:
        asked = files.sparkSession.createDataFrame([(1, site_id, dt)], "request_id int, site_id string, dt string").withColumn("dt", F.col("dt").cast("timestamp"))
        row = nearest_scans(asked, files).first()["filename"]
    if row is None:
        raise RuntimeError(f"no scans of {site_id}" + (f" near {dt}" if dt else ""))
    return row


def cached_scans(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that the cache's listing has too."""
    return files.join(cached.select("site_id", "filename").distinct(), ["site_id", "filename"], "left_semi")


def scan_windows(files: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request_id, site_id, n, end_filename): the last n files of its site, or the n up to and with
    end_filename. Files are in the order of their names. An end that isn't there gives no rows; see require_end."""
    place = Window.partitionBy("request_id").orderBy("filename")
    ranked = requests.join(files.select("site_id", "filename"), "site_id").withColumn("__at", F.row_number().over(place))
    over = Window.partitionBy("request_id")
    last = F.when(F.col("end_filename").isNull(), F.max("__at").over(over)).otherwise(F.max(F.when(F.col("filename") == F.col("end_filename"), F.col("__at"))).over(over))
    return ranked.withColumn("__last", last).filter((F.col("__at") <= F.col("__last")) & (F.col("__at") > F.col("__last") - F.col("n"))).drop("__at", "__last")


def require_end(windows: DataFrame, request_id: object) -> DataFrame:
    """windows as they are; RuntimeError if the request has none."""
    if not windows.filter(F.col("request_id") == F.lit(request_id)).limit(1).count():
        raise RuntimeError(f"the end of window {request_id} isn't among the files")
    return windows


def local_scans(files: DataFrame, cached: DataFrame, site_id: str, day: str, n: int, end_filename: str | None = None) -> DataFrame:
    """A window over the listed files that are cached if there are n; else over the day's cached files, whose names
    must hold a time; else the few that there are."""
    spark = files.sparkSession
    asked = spark.createDataFrame([(1, site_id, n, end_filename)], "request_id int, site_id string, n int, end_filename string")
    have = cached_scans(files.filter(F.col("site_id") == site_id), cached)
    if have.limit(n).count() >= n:
        return scan_windows(have, asked)
    own = cached.filter((F.col("site_id") == site_id) & F.col("filename").contains(day.replace("-", "")) & scan_timestamp("filename").isNotNull())
    return scan_windows(own, asked) if own.limit(1).count() else have
