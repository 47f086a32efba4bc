"""Calendar and clock arithmetic on epoch seconds and dates, free of the session's zone."""

from __future__ import annotations

from pyspark.sql import functions as F


def day_index(s):
    """Days since 2000-01-01."""
    return F.floor(s / 86400) - 10957


def minute_of_day(s):
    return F.pmod(F.floor(s / 60), F.lit(1440))


def weekday(s):
    """Monday is 0 (1970-01-01 was a Thursday)."""
    return F.pmod(F.floor(s / 86400) + 3, F.lit(7))


#: kind -> (seconds between slots, first slot of the day, seconds until a slot's data is out). Fixed values.
SLOTS = {
    "hourly": (3600, 0, 2400),
    "half_hourly": (3600, 1800, 0),
    "three_hourly": (10800, 7200, 600),
    "ten_minutely": (600, 0, 0),
    "thirty_minutely": (1800, 0, 0),
}


def publication_slot(s, kind: str):
    """The newest issue whose data is out at s: hourly on the hour, out at minute 40; half_hourly once an hour at minute 30;
    three_hourly at 02, 05, .. 23, out ten minutes later; ten_minutely and thirty_minutely are plain grids."""
    every, first, wait = SLOTS[kind]
    return F.floor((s - wait - first) / every) * every + first


def freshness(age_s, ready: int, expired: int, future: int = 300):
    """ready / stale / expired by age in seconds; missing for null, misaligned for times too far ahead."""
    return F.when(age_s.isNull(), "missing").when(age_s < -future, "misaligned").when(age_s <= ready, "ready").when(age_s <= expired, "stale").otherwise("expired")
