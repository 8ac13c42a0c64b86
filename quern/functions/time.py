"""Column expressions over simulated days, stored times and calendar text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of 2025-01-01 UTC, day 0 of simulated time.
DAY_ZERO = 1_735_689_600


def day_to_timestamp(day: Column) -> Column:
    return F.timestamp_micros(F.lit(DAY_ZERO * 1_000_000) + (day * 86_400_000_000).cast("long"))


def seconds_of(text: Column) -> Column:
    """Epoch seconds of an ISO time, null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(text))


def day_of(text: Column) -> Column:
    """The simulated day that a text names: a number cut at its point, or an ISO time's whole days from day 0; else null."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)), F.floor((seconds_of(text) - DAY_ZERO) / 86400))


def epoch_of(text: Column) -> Column:
    """Seconds named by a number or an ISO time, else 0."""
    return F.coalesce(text.try_cast("double"), seconds_of(text).cast("double"), F.lit(0.0))


def calendar_label(time: Column) -> Column:
    return F.date_format(time, "MMMM dd, yyyy")


def dates_in(text: Column) -> Column:
    """Valid dates written year-month-day or year/month/day, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}[-/]\d{2}[-/]\d{2}"), F.lit(0)), lambda x: F.replace(x, F.lit("/"), F.lit("-")).try_cast("date")))


def time_of_day(hour: Column) -> Column:
    steps = [(9, "early in the morning"), (11, "mid-morning"), (13, "around midday"), (15, "early afternoon"), (18, "in the afternoon"), (21, "in the evening")]
    out = F.when(hour < steps[0][0], steps[0][1])
    for limit, label in steps[1:]:
        out = out.when(hour < limit, label)
    return out.otherwise("late at night")


def clock(hour: Column) -> Column:
    """7am, 11:30pm and the like of a fractional hour."""
    h = F.pmod(hour, F.lit(24.0))
    whole = F.floor(h).cast("int")
    shown = F.when(whole % 12 == 0, 12).otherwise(whole % 12).cast("string")
    minutes = F.floor((h - F.floor(h)) * 60).cast("int")
    return F.concat(shown, F.when(minutes > 0, F.concat(F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise(""), F.when(h < 12, "am").otherwise("pm"))
