"""Time as epoch milliseconds: integer arithmetic that no session time zone can change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pingloom.config import DAY_MS, DEFAULTS, HOUR_MS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(value: Column | str, step: int) -> Column:
    return F.floor(_col(value) / F.lit(step)).cast("long")


def ms_to_ts(ms: Column | str) -> Column:
    return F.timestamp_millis(_col(ms))


def ts_to_ms(ts: Column | str) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def local_ms(ms: Column | str, offset_h: int = DEFAULTS.local_offset_h) -> Column:
    return _col(ms) + F.lit(offset_h * HOUR_MS)


def zone_ms(ms: Column | str, tz: str) -> Column:
    """Wall-clock milliseconds in a real zone (daylight saving included)."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(_col(ms)), tz))


def hour_of(ms: Column | str) -> Column:
    return F.pmod(floor_div(ms, HOUR_MS), F.lit(24)).cast("int")


def local_hour(ms: Column | str, offset_h: int = DEFAULTS.local_offset_h) -> Column:
    return hour_of(local_ms(ms, offset_h))


def minute_of_hour(ms: Column | str) -> Column:
    return F.pmod(floor_div(ms, 60_000), F.lit(60)).cast("int")


def minutes_since_midnight(ms: Column | str) -> Column:
    return F.pmod(floor_div(ms, 60_000), F.lit(1440)).cast("int")


def seconds_since_midnight(ms: Column | str) -> Column:
    return F.pmod(floor_div(ms, 1000), F.lit(86_400)).cast("int")


def weekday(ms: Column | str) -> Column:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return F.pmod(floor_div(ms, DAY_MS) + F.lit(3), F.lit(7)).cast("int")


def epoch_day(ms: Column | str) -> Column:
    return floor_div(ms, DAY_MS)


def service_date(ms: Column | str, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(_col(ms)), tz))


def is_weekday(ms: Column | str) -> Column:
    return weekday(ms) < 5


def calendar_parts(ms: Column | str) -> dict[str, Column]:
    return {
        "hour": hour_of(ms),
        "minute": minute_of_hour(ms),
        "day_of_week": weekday(ms),
        "minutes_since_midnight": minutes_since_midnight(ms),
        "is_weekend": (weekday(ms) >= 5).cast("int"),
        "is_weekday": (weekday(ms) < 5).cast("int"),
    }


def seconds_to_clock(sec: Column | str) -> Column:
    """``HH:MM:SS``; hours may exceed 23 on a service day, NULL stays NULL."""
    s = _col(sec).cast("long")
    clock = F.format_string("%02d:%02d:%02d", floor_div(s, 3600), F.pmod(floor_div(s, 60), F.lit(60)), F.pmod(s, F.lit(60)))
    return F.when(s.isNotNull(), clock)


def clock_to_seconds(clock: Column | str) -> Column:
    """Seconds of an ``H:M[:S]`` text; NULL when a part is no number."""
    parts = F.split(F.trim(_col(clock)), ":")
    h, m = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    s = F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(3)).try_cast("int")).otherwise(F.lit(0))
    return h * 3600 + m * 60 + s


def local_text_to_utc_ms(date_text: Column | str, clock_text: Column | str, tz: str) -> Column:
    """Local date (``M/d/yyyy`` or ``yyyy-MM-dd``) plus clock to UTC milliseconds.

    A wall time that occurs twice (autumn) is NULL; one that never occurs (spring) moves to the
    first instant after the gap.
    """
    d = _col(date_text)
    day = F.coalesce(F.try_to_timestamp(d, F.lit("M/d/yyyy")), F.try_to_timestamp(d, F.lit("yyyy-MM-dd")))
    wall = F.timestamp_millis(F.unix_millis(day) + clock_to_seconds(clock_text).cast("long") * 1000)
    guess = F.to_utc_timestamp(wall, tz)
    hour_later = F.timestamp_millis(F.unix_millis(guess) + HOUR_MS)
    hour_before = F.timestamp_millis(F.unix_millis(guess) - HOUR_MS)
    ambiguous = (F.from_utc_timestamp(hour_later, tz) == wall) | (F.from_utc_timestamp(hour_before, tz) == wall)
    in_gap = F.from_utc_timestamp(guess, tz) != wall
    after_gap = F.to_utc_timestamp(F.date_trunc("hour", wall), tz)
    return F.unix_millis(F.when(ambiguous, F.lit(None)).when(in_gap, after_gap).otherwise(guess))
