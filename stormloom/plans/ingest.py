"""From gate tables to objects, wind and tracks: the whole chain as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.detection import detect_objects
from ..operators.quality import remove_speckle, scan_quality, speckle_gates
from ..operators.unfolding import unfold_velocity
from ..operators.velocity import analyze_velocity
from ..sources import volumes
from ..sources.landing import landed
from ..streaming.tracker import scan_rows, track_scans


@dataclass
class Ingested:
    scans: DataFrame
    gates: DataFrame
    quality: DataFrame
    objects: DataFrame
    object_gates: DataFrame
    hierarchy: DataFrame
    regions: DataFrame
    rotations: DataFrame
    tracked: DataFrame | None  # None where objects aren't followed


def ingest(scans: DataFrame, gates: DataFrame, velocity_sweeps: DataFrame, velocity_gates: DataFrame) -> Ingested:
    """Clean, detect, analyse the wind and follow the objects. Results that several others read are
    written to the shared folder and read back."""
    speckle = landed(speckle_gates(gates), "speckle")
    clean = landed(remove_speckle(gates, speckle), "clean-gates")
    found = detect_objects(scans, clean)
    wind = analyze_velocity(velocity_sweeps, velocity_gates, found.objects)
    objects, quality = landed(wind.objects, "objects-with-wind"), landed(scan_quality(scans, gates, speckle), "quality")
    tracked = landed(track_scans(scan_rows(scans, clean, objects, found.object_gates, quality)), "tracked")
    return Ingested(scans, clean, quality, objects, found.object_gates, found.hierarchy, wind.regions, wind.rotations, tracked)


def ingest_archive(files: DataFrame) -> Ingested:
    """The chain over archive files (volumes.archive_files): the lowest reflectivity sweep, and the lowest velocity sweeps
    unfolded. The decoded tables are written once."""
    sweeps, gates = volumes.archive_volumes(files)
    sweeps, gates = landed(sweeps, "volume-sweeps"), landed(gates, "volume-gates")
    heads = volumes.velocity_sweeps(sweeps)
    return ingest(volumes.reflectivity_scans(sweeps), volumes.reflectivity_gates(gates), heads, landed(unfold_velocity(heads, volumes.velocity_gates(gates)), "unfolded-gates"))
