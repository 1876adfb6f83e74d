"""Dates and times: zones, ranges, labels and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightquay.functions.text import _col, bound

#: Month names as they are written in ranges (fixed values).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_M = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, whatever the session's zone is."""
    return F.unix_millis(ts.cast("timestamp"))


def zone_offset_minutes(utc_ms: Column, zone: str) -> Column:
    """Minutes that a zone is ahead of UTC at an instant."""
    at = F.timestamp_millis(utc_ms)
    return ((F.unix_millis(F.from_utc_timestamp(at, zone)) - utc_ms) / 60000).cast("int")


def local_to_utc(local_ms: Column, zone: str) -> Column:
    """Instant of a wall clock given as if it were UTC; the offset is looked up twice, which settles gaps and overlaps."""
    offset = lambda ms: zone_offset_minutes(ms, zone).cast("long") * 60000
    return bound(local_ms, lambda wall: bound(wall - offset(wall), lambda first: wall - offset(first)))


def utc_day(ms: Column) -> Column:
    """Day of an instant in UTC, yyyy-MM-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int")), "yyyy-MM-dd")


def half_day_slot(ms: Column) -> Column:
    """Number of the 12-hour slot of an instant."""
    return F.floor(ms / 43200000)


def age_hours(ms: Column, now_ms: Column) -> Column:
    """Hours between an instant and now."""
    return (now_ms - ms) / 3.6e6


def iso_duration(ms: Column) -> Column:
    """``P1DT2H30M``; parts of zero are left out, and nothing at all is PT0M."""
    minutes = F.floor(ms / 60000)
    d, h, m = F.floor(minutes / 1440), F.floor(minutes / 60) % 24, minutes % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    clock = F.concat(part(h, "H"), part(m, "M"))
    whole = F.concat(F.lit("P"), part(d, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.when(whole == "P", "PT0M").otherwise(whole)


def structured_schedule(start: Column, end: Column) -> Column:
    """(start, end) in ms when both parse and the end is later, else null."""
    a, b = (F.unix_millis(F.try_to_timestamp(x)) for x in (start, end))
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end")))


def suspect_schedule(start_ms: Column, end_ms: Column, zone: str, first_hour: int = 6, least_hours: float = 1.5) -> Column:
    """A start before ``first_hour`` local time, or less than ``least_hours`` long."""
    hour = F.hour(F.from_utc_timestamp(F.timestamp_millis(start_ms), zone))
    return (hour < first_hour) | ((end_ms - start_ms) / 3.6e6 < least_hours)


def date_only(value: Column | str) -> Column:
    """A date without a clock."""
    return _col(value).rlike(r"^\d{4}-\d{2}-\d{2}\z")


def junk_seconds(ts: Column) -> Column:
    """Seconds that no one would state: the value is a date only."""
    return F.second(ts) != 0


def parse_range(text: Column | str) -> Column:
    """(start, end) dates of a range with a year, as :func:`brightquay.functions.stated.range_instants` reads it."""
    from brightquay.functions.stated import range_instants

    return bound(range_instants(text, "UTC"), lambda r: F.when(r.isNotNull(), F.struct(F.to_date(F.timestamp_millis(r["start"])).alias("start"), F.to_date(F.timestamp_millis(r["end"])).alias("end"))))


def year_by_weekday(month: Column, day: Column, weekday: Column, year: Column) -> Column:
    """Of a year and the next, the first whose date falls on ``weekday`` (Mon, Tue, ...)."""
    fits = lambda y: F.date_format(F.call_function("try_make_timestamp", y, month, day, F.lit(0), F.lit(0), F.lit(0)), "E") == weekday
    return F.when(fits(year), year).when(fits(year + 1), year + 1)


def month_group(ts: Column) -> Column:
    """Heading of a month."""
    return F.date_format(ts, "MMMM yyyy")


def day_label(ts: Column) -> Column:
    """``AUG 28``."""
    return F.upper(F.date_format(ts, "MMM d"))


def all_day_span(start: Column, end: Column, longest: int = 3) -> Column:
    """(first day, day after the last) of a calendar entry; longer ones show their first day only."""
    a, b = F.to_date(start), F.to_date(end)
    last = F.when(F.datediff(b, a) + 1 > longest, a).otherwise(F.greatest(a, b))
    return F.struct(a.alias("first"), F.date_add(last, 1).alias("after"))
