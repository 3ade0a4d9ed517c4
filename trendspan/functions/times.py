"""Column functions over times: windows, schedules, durations, local dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours that a source is read back at least and at most, and the overlap in minutes.
WINDOW_LEAST, WINDOW_MOST, WINDOW_OVERLAP = 24, 96, 45


def seconds(t: Column) -> Column:
    """Seconds since 1970 of a time taken as UTC, with their fraction."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def window_hours(now: Column, last: Column) -> Column:
    """Hours to read back: since ``last`` plus the overlap, rounded up, within limits; the least without a ``last``."""
    hours = F.ceil((seconds(now) - seconds(last) + WINDOW_OVERLAP * 60) / 3600)
    # greatest and least pass over nulls, so a missing time has to be told apart.
    return F.when(last.isNull(), WINDOW_LEAST).otherwise(F.greatest(F.lit(WINDOW_LEAST), F.least(F.lit(WINDOW_MOST), hours))).cast("int")


def age_hours(now: Column, t: Column) -> Column:
    return (seconds(now) - seconds(t)) / 3600


def half_life(age: Column, half: float) -> Column:
    """0.5 to the power of age over half-life; future ages give more than one."""
    return F.pow(F.lit(0.5), age / F.lit(half))


def snapshot_id_kst(t: Column) -> Column:
    """A UTC time as a snapshot's name in Korean time."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), t), "yyyyMMdd_HHmm")


def pacific_date(t: Column) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), t))


def iso_duration_seconds(text: Column) -> Column:
    """PT#H#M#S in seconds; null where the text is no such duration."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(r"^PT(?=\d)(\d+H)?(\d+M)?(\d+S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))


def video_type(duration: Column) -> Column:
    """Videos of up to three minutes are shorts."""
    return F.when(duration.isNull(), "unknown").when(duration <= 180, "shorts").otherwise("longform")


def guess_year(month_day: Column, now: Column) -> Column:
    """A date without a year: this year's, or last year's if that is more than seven days ahead."""
    this = F.to_date(F.concat(F.year(now).cast("string"), F.lit("-"), month_day))
    return F.when(this > F.date_add(F.to_date(now), 7), F.add_months(this, -12)).otherwise(this)


def manual_expiry(now: Column, expires: Column, ttl: Column) -> Column:
    """A manual row's new end: its TTL (6, 12 or 24 hours, else 6) from its end while active, from now otherwise."""
    hours = F.when(ttl.isin(6, 12, 24), ttl).otherwise(6)
    return F.greatest(F.coalesce(expires, now), now) + F.make_dt_interval(hours=hours.cast("int"))


def next_slot(t: Column, slots: list[str]) -> Column:
    """The first of the day's times after ``t``, or tomorrow's first; slots are distinct, sorted HH:MM."""
    day = F.date_trunc("day", t).cast("timestamp_ntz")
    times = [day + F.make_dt_interval(hours=F.lit(int(s[:2])), mins=F.lit(int(s[3:]))) for s in sorted(set(slots))]
    found = F.when(F.lit(False), times[0])
    for x in times:
        found = found.when(x > t, x)
    return found.otherwise(times[0] + F.make_dt_interval(days=F.lit(1)))
