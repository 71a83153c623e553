"""Column functions: distances, beam geometry, bearings, labels and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0
LOWEST_BEAM_DEG = 0.5
KM_PER_MILE = 1.60934
INTENSITY = [(20.0, 30.0, "light rain"), (30.0, 40.0, "moderate rain"), (40.0, 50.0, "heavy rain"), (50.0, 60.0, "intense rain"), (60.0, math.inf, "severe core")]
BEARINGS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
STRONG_SHEAR, MODERATE_SHEAR = 35.0, 25.0
HIGH, MEDIUM = 0.75, 0.45

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x: ColumnOrName, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def haversine_km(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    """Great-circle distance."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def beam_height_m(distance_km: ColumnOrName, elevation_m: ColumnOrName) -> Column:
    """Height of the lowest beam: its slope, the Earth's curve and the antenna."""
    d = col(distance_km) * 1000
    return d * math.tan(math.radians(LOWEST_BEAM_DEG)) + d * d / (2000 * EARTH_KM) + col(elevation_m)


def polar_to_lat_lon(lat: ColumnOrName, lon: ColumnOrName, azimuth_deg: ColumnOrName, range_m: ColumnOrName) -> tuple[Column, Column]:
    """The place at an azimuth and range from a radar; the longitude isn't brought into -180 to 180."""
    phi, az, delta = F.radians(col(lat)), F.radians(col(azimuth_deg)), col(range_m) / (1000 * EARTH_KM)
    there = F.asin(F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(az))
    turn = F.atan2(F.sin(az) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * F.sin(there))
    return F.degrees(there), F.degrees(F.radians(col(lon)) + turn)


def intensity_label(dbz: ColumnOrName) -> Column:
    out = F.when(col(dbz) < INTENSITY[0][0], "drizzle")
    for low, high, label in INTENSITY:
        out = out.when((col(dbz) >= low) & (col(dbz) < high), label)
    return out.otherwise(INTENSITY[-1][2])


def bearing_label(degrees: ColumnOrName) -> Column:
    """One of 16 points of the compass; halves go to the even point."""
    return F.get(F.array(*map(F.lit, BEARINGS)), F.pmod(F.rint(col(degrees) / 22.5).cast("int"), F.lit(16)))


def rotation_strength(shear: ColumnOrName) -> Column:
    return F.when(col(shear) >= STRONG_SHEAR, "strong").when(col(shear) >= MODERATE_SHEAR, "moderate").otherwise("weak")


def confidence_label(score: ColumnOrName) -> Column:
    return F.when(col(score) >= HIGH, "high").when(col(score) >= MEDIUM, "medium").otherwise("low")


def miles(km: ColumnOrName) -> Column:
    return F.rint(col(km) / KM_PER_MILE).cast("int")


def square_miles(km2: ColumnOrName) -> Column:
    return F.rint(col(km2) / KM_PER_MILE**2).cast("int")


def heading_delta(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Degrees between two headings, 0 to 180; 0 if either is null."""
    d = F.abs(col(a) - col(b)) % 360
    return F.coalesce(F.least(d, 360 - d), F.lit(0.0))


def signed_heading_delta(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The turn from a to b, -180 to 180; 0 if either is null."""
    return F.coalesce(F.pmod(col(b) - col(a) + 540, F.lit(360.0)) - 180, F.lit(0.0))


def circular_mean(headings: ColumnOrName) -> Column:
    """Mean direction of an array of headings; null if it is empty or they cancel out."""

    def total(f) -> Column:
        return F.aggregate(col(headings), F.lit(0.0), lambda s, x: s + f(F.radians(x)))

    s, c = total(F.sin), total(F.cos)
    return F.when((F.size(col(headings)) > 0) & ((F.abs(s) >= 1e-6) | (F.abs(c) >= 1e-6)), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def scan_quality_factor(score: ColumnOrName) -> Column:
    return F.coalesce(clamp(score, 0.25), F.lit(1.0))


def round_even(x: Column, places: int) -> Column:
    """Half to even of the scaled double, as SQL engines round; bround() goes by the shortest decimal text, which is another
    number next to a tie."""
    return F.rint(x * 10.0**places) / 10.0**places


def match_quality(total_cost: ColumnOrName) -> Column:
    return F.bround(clamp(1 - col(total_cost) / 10), 2)


def interpolated(axis: ColumnOrName, place: ColumnOrName) -> Column:
    """The axis' value at a fractional index within it."""
    axis, place = col(axis), col(place)
    i = F.least(F.floor(place), F.size(axis) - 2).cast("int")
    i = F.greatest(i, F.lit(0))
    low, high = F.get(axis, i), F.coalesce(F.get(axis, i + 1), F.get(axis, i))
    return low + (place - i) * (high - low)


def spacing(axis: ColumnOrName, default: float) -> Column:
    """Signed difference of an axis' first two values."""
    return F.when(F.size(col(axis)) > 1, F.get(col(axis), F.lit(1)) - F.get(col(axis), F.lit(0))).otherwise(F.lit(default))


def gate_area_km2(azimuths: ColumnOrName, ranges_m: ColumnOrName, rng_idx: ColumnOrName) -> Column:
    """Area of a gate of a polar grid; 0 if an axis has fewer than two values."""
    whole = (F.size(col(azimuths)) > 1) & (F.size(col(ranges_m)) > 1)
    area = F.get(col(ranges_m), col(rng_idx)) * F.radians(F.abs(spacing(azimuths, 1.0))) * F.abs(spacing(ranges_m, 0.0)) / 1e6
    return F.when(whole, area).otherwise(F.lit(0.0))
