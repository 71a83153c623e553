"""Archive volumes: what is encoded comes back, through bytes, files and the data source."""

from __future__ import annotations

import bz2
import gzip
import struct
from datetime import datetime, timezone

import numpy as np
import pytest

from stormloom.plans.ingest import ingest_archive
from stormloom.sources import level2, volumes
from stormloom.sources.level2 import Sweep, Volume

from .conftest import grid

START = datetime(2026, 4, 8, 18, 30, 0, 250_000, tzinfo=timezone.utc)
SCALE = {"reflectivity": (2.0, 66.0), "velocity": (2.0, 129.0)}


def volume(n_az: int = 130, n_rng: int = 90, cuts: int = 4) -> Volume:
    """Surveillance and Doppler cuts in turn; half-unit values, so 8 bits hold them."""
    rng = np.random.default_rng(2)
    out = Volume("KTLX", START, float(np.float32(35.333)), float(np.float32(-97.278)))
    for k in range(cuts):
        for moment in (("reflectivity",), ("velocity",))[k] if k < 2 else ("reflectivity", "velocity"):
            values = rng.integers(-50, 90, (n_az, n_rng)) / 2.0
            values[rng.random(values.shape) < 0.3] = np.nan
            out.sweeps.append(Sweep(moment, k, np.arange(n_az) * 0.5, 0.5 + k, 26.25, 2125, 250, values))
    return out


def same(a: Volume, b: Volume) -> None:
    assert (a.site_id, a.start, a.lat, a.lon) == (b.site_id, b.start, b.lat, b.lon)
    assert [(s.moment, s.sweep_idx) for s in a.sweeps] == [(s.moment, s.sweep_idx) for s in sorted(b.sweeps, key=lambda s: (s.sweep_idx, s.moment))]
    for x, y in zip(a.sweeps, sorted(b.sweeps, key=lambda s: (s.sweep_idx, s.moment)), strict=True):
        np.testing.assert_array_equal(x.values, y.values)
        np.testing.assert_array_equal(x.azimuths, y.azimuths)
        np.testing.assert_array_equal(x.ranges_m, y.ranges_m)
        assert (x.elevation, x.nyquist) == (y.elevation, y.nyquist)


@pytest.mark.parametrize("bits", [8, 16])
def test_round_trip(bits):
    v = volume()
    data = level2.encode_volume(v, SCALE, bits)
    same(level2.decode_volume(data), v)
    same(level2.decode_volume(gzip.compress(data)), v)
    at, plain = level2.VOLUME_HEADER.size, data[: level2.VOLUME_HEADER.size]
    while at < len(data):  # the same volume without compression
        size = struct.unpack_from(">i", data, at)[0]
        plain += bz2.decompress(data[at + 4 : at + 4 + size])
        at += 4 + size
    same(level2.decode_volume(plain), v)


def test_what_is_asked_for():
    data = level2.encode_volume(volume(), SCALE, 8)
    assert [(s.moment, s.sweep_idx) for s in level2.decode_volume(data, ["velocity"], 3).sweeps] == [("velocity", 1), ("velocity", 2)]
    folded = level2.encode_volume(Volume("KSOX", START, 1.0, 2.0, [Sweep("velocity", 0, np.array([0.0]), 0.5, 8.0, 0, 250, np.array([[-200.0, 1.0]]))]), SCALE, 8)
    assert level2.decode_volume(folded).sweeps[0].values.tolist() == [[-63.5, 1.0]]  # the smallest word for a value
    with pytest.raises(ValueError, match="no Level II"):
        level2.decode_volume(b"GRIB" + bytes(100))


def test_folder_of_files(spark, tmp_path):
    """Headers and gates by Spark's file reader, by the data source, and with filters that reach the decoder."""
    vs = [volume(cuts=c) for c in (2, 4)]
    for k, v in enumerate(vs):
        (tmp_path / f"KTLX2026040{k + 1}_183000_V06").write_bytes(level2.encode_volume(v, SCALE, 8))
    files = volumes.archive_files(spark, str(tmp_path))
    sweeps, gates = volumes.archive_volumes(files)
    assert sweeps.count() == sum(len(v.sweeps) for v in vs)
    want = sorted(x for v in vs for s in v.sweeps for x in zip([s.moment] * s.values.size, [s.sweep_idx] * s.values.size, *(i.ravel().tolist() for i in np.indices(s.values.shape)), s.values.ravel().tolist(), strict=True) if x[4] == x[4])
    assert sorted(tuple(r)[1:] for r in gates.collect()) == want
    heads, own = volumes.read_reflectivity(spark, str(tmp_path))
    assert {(r.elevation, tuple(r.elevations), str(r.scan_ts)) for r in heads.collect()} == {(0.5, (0.5, 1.5), "2026-04-08 18:30:00"), (0.5, (0.5, 1.5, 2.5, 3.5), "2026-04-08 18:30:00")}
    assert own.count() == sum(np.isfinite(v.sweeps[0].values).sum() for v in vs)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(volumes.RadarArchive)
    paths = ",".join(str(p) for p in sorted(tmp_path.iterdir()))
    source = spark.read.format("radar_archive").option("paths", paths).load()
    assert sorted(tuple(r)[1:] for r in source.collect()) == want
    assert source.filter("moment = 'velocity' AND sweep_idx = 1").count() == sum(np.isfinite(s.values).sum() for v in vs for s in v.sweeps if s.moment == "velocity" and s.sweep_idx == 1)
    assert source.filter("moment IN ('reflectivity') AND sweep_idx < 3 AND rng_idx < 10").count() == sum(x[0] == "reflectivity" and x[1] < 3 and x[3] < 10 for x in want)
    assert spark.read.format("radar_archive").option("paths", paths).option("table", "sweeps").load().filter("moment = 'velocity'").count() == 4


def test_ingest_from_files(spark, tmp_path):
    """The chain over an archive file: one storm, and no wind region in a volume without velocities."""
    dbz = grid((85, 95, 195, 205, 45.0))
    v = Volume("KTLX", START, 35.0, -97.0, [Sweep("reflectivity", 0, np.arange(360.0), 0.5, 26.0, 2000, 497, dbz)])
    (tmp_path / "KTLX20260408_183000_V06").write_bytes(level2.encode_volume(v, SCALE, 8))
    done = ingest_archive(volumes.archive_files(spark, str(tmp_path)))
    assert [(r.peak_dbz, r.peak_label) for r in done.objects.collect()] == [(45.0, "heavy rain")]
    assert done.regions.count() == 0


def test_tables_to_files(spark):
    """Volumes packed from tables; a volume without gates; none."""
    sweeps = spark.createDataFrame([(7, "KTLX", "reflectivity", 0, "seconds since 2026-04-08T18:30:00Z", [0.0, 1.0], [2000.0, 2250.0, 2500.0], 35.0, -97.0, 0.5, 26.2), (8, "KSOX", "velocity", 0, "seconds since 2026-04-08T18:35:00Z", [0.0], [2000.0], 33.0, -117.0, 0.5, 26.2)], volumes.VOLUME_SWEEPS)
    gates = spark.createDataFrame([(7, "reflectivity", 0, 1, 2, 30.5), (7, "reflectivity", 0, 0, 0, None)], volumes.VOLUME_GATES)
    back, own = volumes.archive_volumes(volumes.pack_volumes(sweeps, gates, SCALE, 8))
    assert [tuple(r) for r in own.collect()] == [(7, "reflectivity", 0, 1, 2, 30.5)]
    assert {(r.scan_id, r.site_id, r.time_units, tuple(r.ranges_m)) for r in back.collect()} == {(7, "KTLX", "seconds since 2026-04-08T18:30:00Z", (2000.0, 2250.0, 2500.0)), (8, "KSOX", "seconds since 2026-04-08T18:35:00Z", (2000.0,))}
    assert volumes.archive_volumes(spark.createDataFrame([], "scan_id long, content binary"))[1].count() == 0
