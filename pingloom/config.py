"""Thresholds of the pipeline. Values that results depend on are fixed here, once."""

from __future__ import annotations

from dataclasses import dataclass

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# fixed values: earth radii used by the different distance definitions
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_MI = 3958.8
EARTH_RADIUS_MI_ROUND = 3959.0
METERS_PER_MILE = 1609.34


@dataclass(frozen=True)
class Box:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


@dataclass(frozen=True)
class Thresholds:
    """One frozen set of parameters; operators take the fields they need with these defaults."""

    # fixed values: cleaning
    box: Box = Box(32.5, 32.7, -85.6, -85.4)
    max_speed_mph: float = 65.0
    vehicle_name_pattern: str = "(?i)jaunt|shuttle"
    idle_pattern_id: int = 9998
    excluded_routes: tuple[int, ...] = (
        777, 230, 231, 216, 217, 218, 219, 220, 221, 222, 223, 224, 225, 226, 227, 228,
    )
    active_status: tuple[int, ...] = (7, 71)
    idle_routes: tuple[int, ...] = (237,)

    # fixed values: labels
    asof_tolerance_ms: int = 2 * HOUR_MS
    strict_tolerance_ms: int = HOUR_MS
    label_min_s: float = 10.0
    label_max_s: float = 7200.0
    label_quantile: float = 0.995
    window_before_ms: int = 60_000
    window_after_ms: int = 120_000

    # fixed values: trajectories
    gps_speed_cap_mps: float = 29.06
    idle_speed_mps: float = 0.894
    min_delta_ms: int = 5_000
    max_gap_ms: int = 300_000
    rolling_s: tuple[int, ...] = (30, 60, 120, 180)

    # fixed values: history and tiers
    local_offset_h: int = -6
    history_min_obs: int = 10
    tier_min_obs: int = 2
    prorated_min_obs: int = 5

    # time slice that bounds how much of one vehicle meets in one task
    slice_ms: int = HOUR_MS


DEFAULTS = Thresholds()
