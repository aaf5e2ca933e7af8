"""Scalar features, encodings and binning as plain Spark columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pingloom.config import DAY_MS, DEFAULTS
from pingloom.functions.times import _col, hour_of, local_ms, minute_of_hour, minutes_since_midnight

# fixed values: hours counted as rush hour
RUSH_HOURS = (7, 8, 9, 16, 17, 18)
# fixed values: class-change times as minutes since midnight
CLASS_CHANGE_MINUTES = (480, 530, 590, 640, 700, 750, 810, 860, 920, 970)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    x = _col(c)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def cyclical(c: Column | str, period: float) -> tuple[Column, Column]:
    angle = _col(c) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def rush_by_hour(ms: Column | str) -> Column:
    return hour_of(ms).isin(*RUSH_HOURS)


def rush_half_open(ms: Column | str) -> Column:
    h = hour_of(ms)
    return ((h >= 7) & (h < 9)) | ((h >= 16) & (h < 18))


def rush_by_minutes(ms: Column | str) -> Column:
    m = minutes_since_midnight(ms)
    return m.between(420, 540) | m.between(960, 1080)


def class_change_listed(ms: Column | str, within: int = 10, times: Sequence[int] = CLASS_CHANGE_MINUTES) -> Column:
    m = minutes_since_midnight(ms)
    return F.exists(F.array(*[F.lit(t) for t in times]), lambda t: F.abs(m - t) <= within)


def class_change_hourly(ms: Column | str) -> Column:
    m = minute_of_hour(ms)
    return (m >= 50) | (m <= 10)


def minutes_since_last_stop(ts_ms: Column | str, last_ms: Column | str) -> Column:
    gap = _col(ts_ms) - _col(last_ms)
    return F.when((gap > 0) & (gap < 3_600_000), gap / F.lit(60_000.0)).otherwise(F.lit(0.0))


def minutes_of_day_to_eta(
    field_minutes: Column | str, ts_ms: Column | str, offset_h: int = DEFAULTS.local_offset_h
) -> tuple[Column, Column]:
    """Feeds write an arrival as minutes since local midnight: seconds left (-1 unless ahead) and a flag."""
    field = F.coalesce(_col(field_minutes), F.lit(0.0))
    now = F.pmod(local_ms(ts_ms, offset_h), F.lit(DAY_MS)) / F.lit(60_000.0)
    left = (field - now) * F.lit(60.0)
    valid = (field > 0) & (left > 0)
    return F.when(valid, left).otherwise(F.lit(-1.0)), valid.cast("int")


def weekday_flags(day_of_week: Column | str) -> dict[str, Column]:
    return {f"dow_{d}": (_col(day_of_week) == d).cast("int") for d in range(7)}


def eta_text(seconds: Column | str) -> Column:
    s = _col(seconds)
    return F.when(s.isNull(), F.lit(None)).when(s < 60, F.lit("< 1 min")).otherwise(
        F.concat(F.floor(s / 60 + F.lit(0.5)).cast("string"), F.lit(" min"))
    )


def delay_flags(delay_s: Column | str) -> dict[str, Column]:
    d = _col(delay_s)
    return {"on_time": (d <= 0).cast("int"), "is_delayed": (d > 300).cast("int")}


def load_ratio(load: Column | str, capacity: float = 50.0) -> Column:
    return clip(_col(load) / F.lit(capacity), high=1.0)


def scheduled_from_stop_list(stops: Column | str, target: Column | str, now_minutes: Column | str) -> Column:
    """Seconds to the first listed stop with the target id; 0 when absent or past."""
    hit = F.get(F.filter(_col(stops), lambda s: s["id"] == _col(target)), F.lit(0))
    left = (hit["minutes"] - _col(now_minutes)) * F.lit(60.0)
    return F.coalesce(F.greatest(left, F.lit(0.0)), F.lit(0.0))


def heading_change(h1: Column | str, h2: Column | str) -> Column:
    d = F.abs(_col(h1) - _col(h2))
    return F.when(d.isNotNull(), F.least(d, F.lit(360.0) - d))


def bucketize(c: Column | str, edges: Sequence[float], labels: Sequence[str], right_closed: bool = False) -> Column:
    """Label by interval; ``edges`` are the inner limits, one label more than edges."""
    x = _col(c)
    out = F.when(x.isNull(), F.lit(None))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when((x <= edge) if right_closed else (x < edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# fixed values: report buckets (inner limits and names)
TIME_BUCKETS = ((60, 120, 300, 600, 1200), ("0-1min", "1-2min", "2-5min", "5-10min", "10-20min", "20min+"))
LABEL_BUCKETS = ((60, 300, 600, 1800), ("0-60s", "60-300s", "300-600s", "600-1800s", "1800s+"))
STOP_BUCKETS = ((1, 3, 6), ("1", "2-3", "4-6", "7+"))
DISTANCE_BUCKETS = ((1000, 3000, 5000), ("<1km", "1-3km", "3-5km", "5km+"))
DAY_PARTS_FIT = ((6, 10, 14, 18, 23), ("night", "morning", "midday", "afternoon", "evening", "night"))
DAY_PARTS_REPORT = ((6, 11, 14, 18), ("evening", "morning", "midday", "afternoon", "evening"))


def time_of_day(hour: Column | str, parts=DAY_PARTS_REPORT) -> Column:
    return bucketize(hour, *parts)


def stops_bucket(n: Column | str) -> Column:
    return bucketize(n, *STOP_BUCKETS, right_closed=True)


def bin_index(x: Column, edges: Column) -> Column:
    """Right-closed bin of ``x`` among sorted ``edges``, clipped to 0..n-1; NULL or negative is -1."""
    below = F.size(F.filter(edges, lambda e: e < x))
    n_bins = F.size(edges) - 1
    return F.when(x.isNull() | (x < 0), F.lit(-1)).otherwise(
        F.greatest(F.least(below, n_bins), F.lit(1)) - 1
    ).cast("int")


def segment_decile(progress: Column | str, target: Column | str, last: Column | str) -> Column:
    """Tenth of the way left between last and target stop; route-level tenth without a last stop."""
    p, t, s = _col(progress), _col(target), _col(last)
    left = F.when(t - p < 0, t - p + 1).otherwise(t - p)
    span = F.when(t - s <= 0, t - s + 1).otherwise(t - s)
    # span 0 cannot occur: a non-positive span was wrapped by one whole loop
    fine = F.floor(F.try_divide(left, span) * 10)
    coarse = F.floor((t - p) * 10)
    return F.greatest(F.least(F.when(s.isNull(), coarse).otherwise(fine), F.lit(9)), F.lit(0)).cast("int")


def is_stopped(speed: Column | str) -> Column:
    return F.coalesce(_col(speed) == 0, F.lit(False)).cast("int")


def on_time_bin(minutes_off: Column | str) -> Column:
    m = _col(minutes_off)
    return F.when(m.isNull(), -1).when(m < 0, 0).when(m <= 1, 1).when(m <= 5, 2).otherwise(3).cast("int")


def on_time_bin3(minutes_off: Column | str) -> Column:
    m = _col(minutes_off)
    return F.when(m.isNull(), -1).when(m < 0, 0).when(m <= 4, 1).otherwise(2).cast("int")


def predicted_dwell(rates: Column | str, seconds_per_boarding: float = 3.0, stops: int = 3) -> Column:
    head = F.slice(_col(rates), 1, stops)
    return F.aggregate(head, F.lit(0.0), lambda acc, r: acc + r) * F.lit(seconds_per_boarding)


def route_id_num(c: Column | str) -> Column:
    """``215_202`` to 215, ``227_`` to 227, an empty first segment to NULL."""
    first = F.trim(F.element_at(F.split(_col(c).cast("string"), "_"), 1))
    return F.when(first != "", first).try_cast("long")


def normalize_name(c: Column | str) -> Column:
    return F.trim(F.replace(F.replace(F.lower(_col(c)), F.lit("&"), F.lit("and")), F.lit("-"), F.lit(" ")))


def log_label(c: Column | str) -> Column:
    return F.log1p(_col(c))


def unlog_label(c: Column | str) -> Column:
    return F.expm1(_col(c))


def confidence_band(p50: Column | str, p80: Column | str, level: float = 0.8) -> tuple[Column, Column]:
    """Bounds around the median; the upper side is twice as wide and the lower one never negative."""
    if level <= 0.5:
        scale = 0.0
    elif level <= 0.8:
        scale = (level - 0.5) / 0.3
    else:
        scale = 1.0 + (level - 0.8) / 0.2
    reach = (_col(p80) - _col(p50)) * F.lit(scale)
    return F.greatest(_col(p50) - reach * F.lit(0.5), F.lit(0.0)), _col(p50) + reach
