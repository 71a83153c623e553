"""Level II archive volumes as bytes: decoded into sweeps, and encoded from them.

A volume is a header and blocks that are compressed one by one; a block holds messages, and a message of type 31 holds one
ray: where the beam pointed, the site, the unambiguous velocity, and a block of gates for each moment.
"""

from __future__ import annotations

import bz2
import gzip
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import numpy as np

# Fixed values of the format
VOLUME_HEADER = struct.Struct(">9s3sII4s")
CHANNEL_BYTES = 12
MESSAGE_HEADER = struct.Struct(">HBBHHIHH")
RAY_HEADER = struct.Struct(">4sIHHfBBHBBBBfBBH")
VOLUME_BLOCK = struct.Struct(">4sHBBffhHfffffHH")
ELEVATION_BLOCK = struct.Struct(">4sHhf")
RADIAL_BLOCK = struct.Struct(">4sHHffHH")
MOMENT_BLOCK = struct.Struct(">4sIHHHHhBBff")
RAY_MESSAGE, OTHER_MESSAGE_BYTES = 31, 2432
METADATA_MESSAGES, RAYS_OF_A_BLOCK = 134, 120
BELOW_THRESHOLD, RANGE_FOLDED = 0, 1
MOMENTS = {b"DREF": "reflectivity", b"DVEL": "velocity"}
EPOCH = datetime(1969, 12, 31, tzinfo=timezone.utc)  # day 1 is 1970-01-01


@dataclass
class Sweep:
    moment: str
    sweep_idx: int
    azimuths: np.ndarray
    elevation: float
    nyquist: float
    first_m: int
    step_m: int
    values: np.ndarray  # rays by gates, NaN where nothing was measured

    @property
    def ranges_m(self) -> np.ndarray:
        return self.first_m + self.step_m * np.arange(self.values.shape[1], dtype=float)


@dataclass
class Volume:
    site_id: str
    start: datetime
    lat: float
    lon: float
    sweeps: list[Sweep] = field(default_factory=list)


def _messages(data: bytes) -> Iterable[bytes]:
    """The bytes of the rays' messages, without their headers."""
    at = VOLUME_HEADER.size
    compressed = data[at + 4 : at + 6] == b"BZ"
    while at + 4 <= len(data):
        if compressed:
            size = abs(struct.unpack_from(">i", data, at)[0])
            if not size:
                return
            block = bz2.decompress(data[at + 4 : at + 4 + size])
            at += 4 + size
        else:
            block, at = data[at:], len(data)
        place = 0
        while place + CHANNEL_BYTES + MESSAGE_HEADER.size <= len(block):
            halves, _, kind, *_ = MESSAGE_HEADER.unpack_from(block, place + CHANNEL_BYTES)
            if kind == RAY_MESSAGE and halves:
                yield block[place + CHANNEL_BYTES + MESSAGE_HEADER.size : place + CHANNEL_BYTES + 2 * halves]
                place += CHANNEL_BYTES + 2 * halves
            else:
                place += OTHER_MESSAGE_BYTES


def decode_volume(data: bytes, moments: Iterable[str] = tuple(MOMENTS.values()), sweeps_below: int | None = None) -> Volume:
    """The sweeps of the moments asked for, numbered by elevation cut from 0 in the order of the file. Rays of a sweep may
    have different numbers of gates; what a ray lacks is missing. A file that is no volume raises ValueError."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < VOLUME_HEADER.size or not (data.startswith((b"AR2V", b"ARCHIVE2"))):
        raise ValueError("no Level II volume")
    wanted = {k for k, v in MOMENTS.items() if v in set(moments)}
    _, _, day, millis, site = VOLUME_HEADER.unpack_from(data)
    volume = Volume(site.decode("ascii", "replace").strip("\0 "), EPOCH + timedelta(days=day, milliseconds=millis), float("nan"), float("nan"))
    cuts: dict[int, int] = {}
    rays: dict[tuple[int, bytes], list[tuple]] = {}
    for body in _messages(data):
        head = RAY_HEADER.unpack_from(body)
        azimuth, cut, elevation, blocks = head[4], head[10], head[12], head[15]
        sweep = cuts.setdefault(cut, len(cuts))
        if sweeps_below is not None and sweep >= sweeps_below:
            continue
        nyquist, found = float("nan"), []
        for at in struct.unpack_from(f">{blocks}I", body, RAY_HEADER.size):
            name = body[at : at + 4]
            if name == b"RVOL":
                volume.lat, volume.lon = VOLUME_BLOCK.unpack_from(body, at)[4:6]
            elif name == b"RRAD":
                nyquist = RADIAL_BLOCK.unpack_from(body, at)[5] / 100
            elif name in wanted:
                _, _, gates, first, step, _, _, _, bits, scale, offset = MOMENT_BLOCK.unpack_from(body, at)
                raw = np.frombuffer(body, ">u2" if bits == 16 else "u1", gates, at + MOMENT_BLOCK.size)
                found.append((name, first, step, raw, scale, offset))
        for name, first, step, raw, scale, offset in found:
            value = np.where(raw > RANGE_FOLDED, (raw.astype(float) - offset) / (scale or 1.0), np.nan)
            rays.setdefault((sweep, name), []).append((azimuth, elevation, nyquist, first, step, value))
    for (sweep, name), of in sorted(rays.items()):
        width = max(len(r[5]) for r in of)
        values = np.full((len(of), width), np.nan)
        for k, r in enumerate(of):
            values[k, : len(r[5])] = r[5]
        azimuths, elevations = (np.array([r[c] for r in of], float) for c in (0, 1))
        volume.sweeps.append(Sweep(MOMENTS[name], sweep, azimuths, float(elevations.mean()), of[0][2], of[0][3], of[0][4], values))
    return volume


def encode_volume(volume: Volume, scale: dict[str, tuple[float, float]], bits: int = 16) -> bytes:
    """The bytes of a volume. A gate holds the value times a scale plus an offset, rounded to the nearest whole number (half
    to even) and at least 2; scale: both numbers by moment."""
    days, rest = divmod(volume.start - EPOCH, timedelta(days=1))
    millis = rest // timedelta(milliseconds=1)
    out = [VOLUME_HEADER.pack(b"AR2V0006.", b"001", days, millis, volume.site_id.encode()[:4].ljust(4))]

    def add(block: bytes) -> None:
        packed = bz2.compress(block)
        out.append(struct.pack(">i", len(packed)) + packed)

    add(bytes(METADATA_MESSAGES * OTHER_MESSAGE_BYTES))
    names = {v: k for k, v in MOMENTS.items()}
    cuts: dict[int, list[Sweep]] = {}
    for s in volume.sweeps:
        cuts.setdefault(s.sweep_idx, []).append(s)
    number, held = 0, []
    for cut in sorted(cuts):
        for ray in range(len(cuts[cut][0].azimuths)):
            first = cuts[cut][0]
            parts = [
                VOLUME_BLOCK.pack(b"RVOL", VOLUME_BLOCK.size, 1, 0, volume.lat, volume.lon, 0, 0, 0, 0, 0, 0, 0, 0, 0),
                ELEVATION_BLOCK.pack(b"RELV", ELEVATION_BLOCK.size, 0, 0),
                RADIAL_BLOCK.pack(b"RRAD", RADIAL_BLOCK.size, 0, 0, 0, round(first.nyquist * 100), 0),
            ]
            for s in cuts[cut]:
                by, offset = scale[s.moment]
                raw = np.clip(np.rint(s.values[ray] * by + offset), 2, 2**bits - 1)
                gates = np.where(np.isnan(raw), BELOW_THRESHOLD, raw).astype(">u2" if bits == 16 else "u1").tobytes()
                parts.append(MOMENT_BLOCK.pack(names[s.moment], 0, s.values.shape[1], s.first_m, s.step_m, 0, 0, 0, bits, by, offset) + gates)
            at, places = RAY_HEADER.size + 4 * len(parts), []
            for p in parts:
                places.append(at)
                at += len(p)
            head = RAY_HEADER.pack(volume.site_id.encode()[:4].ljust(4), millis, days, ray + 1, first.azimuths[ray], 0, 0, at, 1, 0, cut + 1, 0, first.elevation, 0, 0, len(parts))
            body = head + struct.pack(f">{len(parts)}I", *places) + b"".join(parts)
            body += bytes(len(body) % 2)
            number += 1
            held.append(bytes(CHANNEL_BYTES) + MESSAGE_HEADER.pack((MESSAGE_HEADER.size + len(body)) // 2, 0, RAY_MESSAGE, number % 0x7FFF, days, millis, 1, 1) + body)
            if len(held) == RAYS_OF_A_BLOCK:
                add(b"".join(held))
                held = []
    if held:
        add(b"".join(held))
    return b"".join(out)
