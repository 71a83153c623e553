"""Radar volumes: the tables of an archive, what is taken from them, and a data source that decodes archive files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from .level2 import MOMENTS, Sweep, Volume, decode_volume, encode_volume
from .schemas import VOLUME_GATES, VOLUME_SWEEPS

MAX_VELOCITY_SWEEPS = 3
MOMENT_NAMES = tuple(MOMENTS.values())
HEAD_TYPES = pa.schema([("scan_id", pa.int64()), ("site_id", pa.string()), ("moment", pa.string()), ("sweep_idx", pa.int32()), ("time_units", pa.string()), ("azimuths", pa.list_(pa.float64())), ("ranges_m", pa.list_(pa.float64())), *[(c, pa.float64()) for c in ("radar_lat", "radar_lon", "elevation", "nyquist")]])
GATE_TYPES = pa.schema([("scan_id", pa.int64()), ("moment", pa.string()), ("sweep_idx", pa.int32()), ("az_idx", pa.int32()), ("rng_idx", pa.int32()), ("value", pa.float64())])


def reflectivity_scans(sweeps: DataFrame) -> DataFrame:
    """Headers of the lowest reflectivity sweep of each volume, with the volume's distinct elevations to one decimal
    and the time from 'seconds since <time>'."""
    own = sweeps.filter("moment = 'reflectivity'")
    elevations = sweeps.groupBy("scan_id").agg(F.array_sort(F.collect_set(F.bround("elevation", 1))).alias("elevations"))
    first = own.filter("sweep_idx = 0").withColumn("scan_ts", F.to_timestamp(F.replace("time_units", F.lit("seconds since "), F.lit(""))))
    return first.join(elevations, "scan_id").select("scan_id", "site_id", "scan_ts", "azimuths", "ranges_m", "radar_lat", "radar_lon", "elevation", "elevations")


def reflectivity_gates(gates: DataFrame) -> DataFrame:
    """Finite gates of the lowest reflectivity sweep."""
    return gates.filter("moment = 'reflectivity' AND sweep_idx = 0 AND value IS NOT NULL AND NOT isnan(value)").select("scan_id", "az_idx", "rng_idx", F.col("value").alias("dbz"))


def velocity_sweeps(sweeps: DataFrame, n: int = MAX_VELOCITY_SWEEPS) -> DataFrame:
    """Headers of the lowest n velocity sweeps; none for a volume without velocities."""
    own = sweeps.filter((F.col("moment") == "velocity") & (F.col("sweep_idx") < n))
    return own.select("scan_id", "sweep_idx", "azimuths", "ranges_m", "radar_lat", "radar_lon", "elevation", "nyquist")


def velocity_gates(gates: DataFrame, n: int = MAX_VELOCITY_SWEEPS) -> DataFrame:
    """Finite gates of the lowest n velocity sweeps."""
    own = gates.filter((F.col("moment") == "velocity") & (F.col("sweep_idx") < n) & F.col("value").isNotNull() & ~F.isnan("value"))
    return own.select("scan_id", "sweep_idx", "az_idx", "rng_idx", F.col("value").alias("vel"))


def archive_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(scan_id, path, content) of the archive files at paths (files, folders or patterns, in any store that Spark reads).
    scan_id is a hash of the path. A task gets some files, each of them whole."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.xxhash64("path").alias("scan_id"), "path", "content")


def _heads(scan_id: int, volume: Volume) -> pa.RecordBatch:
    units = f"seconds since {volume.start:%Y-%m-%dT%H:%M:%SZ}"
    rows = [(scan_id, volume.site_id, s.moment, s.sweep_idx, units, s.azimuths.tolist(), s.ranges_m.tolist(), volume.lat, volume.lon, s.elevation, s.nyquist) for s in volume.sweeps]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(HEAD_TYPES.types)], schema=HEAD_TYPES)


def _gates(scan_id: int, volume: Volume) -> Iterator[pa.RecordBatch]:
    for s in volume.sweeps:
        az, rng = np.nonzero(np.isfinite(s.values))
        same = [pa.repeat(pa.scalar(x, t), len(az)) for x, t in ((scan_id, pa.int64()), (s.moment, pa.string()), (s.sweep_idx, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*same, pa.array(az.astype(np.int32)), pa.array(rng.astype(np.int32)), pa.array(s.values[az, rng])], schema=GATE_TYPES)


def _decoded(table: str, moments: tuple[str, ...], sweeps_below: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan_id, content in zip(batch.column(0), batch.column(1), strict=True):
                volume = decode_volume(content.as_py(), moments, sweeps_below)
                yield from [_heads(scan_id.as_py(), volume)] if table == "sweeps" else _gates(scan_id.as_py(), volume)

    return run


def archive_volumes(files: DataFrame, moments: tuple[str, ...] = MOMENT_NAMES, sweeps_below: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sweeps, gates) of volumes given as rows (scan_id, content: the file's bytes), as tables VOLUME_SWEEPS and
    VOLUME_GATES; finite gates only. sweeps_below: rays of higher cuts aren't decoded. A file that is no volume, or that
    is cut off, fails the job. No files: no rows."""
    named = files.select("scan_id", "content")
    return named.mapInArrow(_decoded("sweeps", moments, sweeps_below), VOLUME_SWEEPS), named.mapInArrow(_decoded("gates", moments, sweeps_below), VOLUME_GATES)


def read_reflectivity(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(headers, finite gates) of the lowest reflectivity sweep of each archive file."""
    files = archive_files(spark, *paths)
    sweeps, _ = archive_volumes(files)
    _, gates = archive_volumes(files, ("reflectivity",), 1)
    return reflectivity_scans(sweeps), reflectivity_gates(gates)


def pack_volumes(sweeps: DataFrame, gates: DataFrame, scale: dict[str, tuple[float, float]], bits: int = 16) -> DataFrame:
    """(scan_id, content): archive files of volumes given as tables, one task group a volume. Values are kept as far as
    scale and bits tell them apart; axes must be evenly spaced."""

    def run(heads: pa.Table, rows: pa.Table) -> pa.Table:
        heads, rows = heads.to_pylist(), rows.to_pandas()
        if not heads:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["scan_id", "content"])
        start = datetime.fromisoformat(heads[0]["time_units"].removeprefix("seconds since "))
        volume = Volume(heads[0]["site_id"], start, heads[0]["radar_lat"], heads[0]["radar_lon"])
        for h in sorted(heads, key=lambda h: (h["sweep_idx"], h["moment"])):
            values = np.full((len(h["azimuths"]), len(h["ranges_m"])), np.nan)
            own = rows[(rows["moment"] == h["moment"]) & (rows["sweep_idx"] == h["sweep_idx"]) & rows["value"].notna()]
            values[own["az_idx"], own["rng_idx"]] = own["value"]
            first, *more = h["ranges_m"]
            volume.sweeps.append(Sweep(h["moment"], h["sweep_idx"], np.array(h["azimuths"]), h["elevation"], h["nyquist"], round(first), round(more[0] - first) if more else 0, values))
        return pa.table([pa.array([heads[0]["scan_id"]], pa.int64()), pa.array([encode_volume(volume, scale, bits)], pa.binary())], names=["scan_id", "content"])

    return sweeps.groupBy("scan_id").cogroup(gates.groupBy("scan_id")).applyInArrow(run, "scan_id long, content binary")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str):
        self.paths, self.table, self.moments, self.below = paths, table, MOMENT_NAMES, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Moments that aren't asked for, and cuts above the highest one asked for, aren't decoded."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("moment",):
                self.moments = tuple(m for m in self.moments if m == f.value)
            elif isinstance(f, In) and f.attribute == ("moment",):
                self.moments = tuple(m for m in self.moments if m in f.value)
            elif f.__class__ in (EqualTo, LessThan, LessThanOrEqual) and f.attribute == ("sweep_idx",):
                below = f.value + (not isinstance(f, LessThan))
                self.below = below if self.below is None else min(self.below, below)
                yield f  # equality needs the rows checked again
            else:
                yield f

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        volume = decode_volume(Path(partition.path).read_bytes(), self.moments, self.below)
        scan_id = self.paths.index(partition.path)
        yield from [_heads(scan_id, volume)] if self.table == "sweeps" else _gates(scan_id, volume)


class RadarArchive(DataSource):
    """Format radar_archive: the archive files in option `paths`, comma-separated, in a folder that all executors see; one
    task per file; scan_id is the place in the list. Option `table`: `gates` (default) or `sweeps`. Filters on
    moment and sweep_idx reach the decoder where spark.sql.python.filterPushdown.enabled is set. archive_files() reads from
    other stores."""

    @classmethod
    def name(cls) -> str:
        return "radar_archive"

    def schema(self) -> str:
        return VOLUME_SWEEPS if self.options.get("table") == "sweeps" else VOLUME_GATES

    def reader(self, schema: object) -> DataSourceReader:
        return _ArchiveReader([p for p in self.options.get("paths", "").split(",") if p], self.options.get("table", "gates"))
