"""Distances, bearings and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pingloom.config import EARTH_RADIUS_M
from pingloom.functions.times import _col


def half_chord(lat1, lon1, lat2, lon2) -> Column:
    """The haversine itself; grows with the distance, so it ranks points without the root."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    north, east = F.sin((c - a) / 2), F.sin((d - b) / 2)
    return north * north + F.cos(a) * F.cos(c) * east * east


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    h = half_chord(lat1, lon1, lat2, lon2)
    return F.when(h.isNotNull(), F.asin(F.sqrt(F.least(F.lit(1.0), h))) * F.lit(2 * radius))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def planar_heading(lat1, lon1, lat2, lon2) -> Column:
    """Compass heading on a flat map: 0 north, 90 east."""
    return F.pmod(F.degrees(F.atan2(_col(lon2) - _col(lon1), _col(lat2) - _col(lat1))) + 360, F.lit(360.0))


def folded_angle(h1, h2) -> Column:
    d = F.pmod(F.abs(_col(h1) - _col(h2)), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def heading_alignment(heading, target_bearing) -> Column:
    return F.cos(F.radians(folded_angle(heading, target_bearing)))


def segment_fraction(lat, lon, lat1, lon1, lat2, lon2, tiny: float = 1e-12) -> Column:
    """Clamped position 0..1 of the foot of the perpendicular; 0 on a segment of no length."""
    dx, dy = _col(lon2) - _col(lon1), _col(lat2) - _col(lat1)
    px, py = _col(lon) - _col(lon1), _col(lat) - _col(lat1)
    length2 = dx * dx + dy * dy
    return F.when(length2 < tiny, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(px * dx + py * dy, length2)))
    )
