"""Tables of the data model. A grid is stored sparse, one row per finite gate; its axes are arrays in a header row."""

from __future__ import annotations

#: One reflectivity sweep per scan, the lowest.
SCANS = "scan_id long, site_id string, scan_ts timestamp, azimuths array<double>, ranges_m array<double>, radar_lat double, radar_lon double, elevation double, elevations array<double>"
GATES = "scan_id long, az_idx int, rng_idx int, dbz double"
#: The lowest sweeps with velocities.
VELOCITY_SWEEPS = "scan_id long, sweep_idx int, azimuths array<double>, ranges_m array<double>, radar_lat double, radar_lon double, elevation double, nyquist double"
VELOCITY_GATES = "scan_id long, sweep_idx int, az_idx int, rng_idx int, vel double"
#: A radar volume as an archive holds it: all sweeps and moments.
VOLUME_SWEEPS = "scan_id long, site_id string, moment string, sweep_idx int, time_units string, azimuths array<double>, ranges_m array<double>, radar_lat double, radar_lon double, elevation double, nyquist double"
VOLUME_GATES = "scan_id long, moment string, sweep_idx int, az_idx int, rng_idx int, value double"
MANIFEST = "id string, category string, site_id string, date string, scans int, local_only boolean, end_filename string"
FILES = "site_id string, filename string"
SITES = "site_id string, name string, latitude double, longitude double, elevation_m int"
