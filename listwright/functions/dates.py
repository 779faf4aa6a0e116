"""Date and time functions. The present is always an argument, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000


def age_days(posted: Column, now: Column) -> Column:
    """Fractional days; negative for the future, null without a date."""
    return (F.unix_micros(now) - F.unix_micros(posted)) / F.lit(float(MICROS_A_DAY))


def freshness(posted: Column, now: Column, fold_days: float) -> Column:
    """exp(-age / ``fold_days``), the future counting as now; a half without a date."""
    age = age_days(posted, now)
    age = F.when(age < 0, 0.0).otherwise(age)
    return F.coalesce(F.exp(-age / F.lit(max(0.01, float(fold_days)))), F.lit(0.5))


def tolerant_timestamp(text: Column) -> Column:
    """ISO and RFC 822 dates, UTC where no zone is given; anything else null."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    plain = F.regexp_replace(plain, r"\s(GMT|UTC|UT|Z)$", " +0000")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy")
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(text).try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def epoch_in_slashes(text: Column) -> Column:
    """``/Date(ms)/``, optionally with an offset; negative or malformed is null."""
    ms = F.regexp_extract(text, r"^/Date\((-?\d{1,17})(?:[+-]\d{4})?\)/$", 1).try_cast("long")
    return F.when(ms >= 0, F.timestamp_millis(ms))


def posted_since(posted: Column, now: Column, days: float) -> Column:
    """Within the last ``days``; a row without a date isn't."""
    return F.coalesce(age_days(posted, now) <= F.lit(float(days)), F.lit(False))


def clock(milliseconds: Column) -> Column:
    """m:ss."""
    seconds = F.floor(milliseconds / 1000)
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def step_duration(milliseconds: Column) -> Column:
    """Under a second in ms, under a minute in tenths of seconds, else m:ss."""
    return (
        F.when(milliseconds < 1000, F.format_string("%d ms", milliseconds.cast("long")))
        .when(milliseconds < 60_000, F.format_string("%.1f s", milliseconds / 1000.0))
        .otherwise(clock(milliseconds))
    )


def run_id(started: Column, suffix: Column) -> Column:
    """Sorts by time: ``yyyyMMdd-HHmmss-`` and six hexadecimal digits."""
    return F.concat(F.date_format(started, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(suffix, 1, 6))


def rounded(value: Column) -> Column:
    """To whole numbers, halves to even."""
    return F.rint(value).cast("long")
