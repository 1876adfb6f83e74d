"""Times as sources state them: ranges without years, clocks in prose, durations, date-only values, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightquay.functions.dates import MONTHS, bound, local_to_utc, zone_offset_minutes
from brightquay.functions.text import _col

# The shapes in which sources state times.
TIME_RANGE = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*(?:-|–|—|to|until|till)\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}(?:T00:00:00(?:\.0+)?(?:Z|[+-]00:?00)?)?\z"
MIDNIGHT_IN_OWN_OFFSET = r"T00:00:00(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})\z"
LISTED_RANGE = r"\b([A-Z]{3})\s+(\d{1,2})\s*[-–]\s*(?:([A-Z]{3})\s+)?(\d{1,2})\b"
DURATION = r"(?i)Duration:\s*(?:(\d+)\s*Days?)?[,\s]*(?:(\d+)\s*Hours?)?"
FULL_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ZONE_MINUTES = {"PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "UTC": 0, "GMT": 0}
_WEEKDAYS = "Sunday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday"
_DATE_LINE = rf"^({_WEEKDAYS}), ({'|'.join(FULL_MONTHS)}) (\d{{1,2}})(?:, (\d{{4}}))?\z"
_TIME_LINE = rf"^(\d{{1,2}}):(\d{{2}}) (AM|PM) - (?:({'|'.join(m[:3] for m in FULL_MONTHS)}) (\d{{1,2}}), )?(\d{{1,2}}):(\d{{2}}) (AM|PM)(?: ([A-Z]{{2,5}}))?\z"
DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters in any case; 0 for anything else, null for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")


def utc_ms(year: Column, month: Column, day: Column, minutes: Column | int = 0) -> Column:
    """Milliseconds of a wall clock taken as UTC; days and minutes beyond their bounds carry over."""
    first = F.call_function("try_make_timestamp", year.cast("int"), month.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    days = F.datediff(F.to_date(first), F.lit("1970-01-01").cast("date")).cast("long") + day.cast("long") - 1
    return days * DAY_MS + (F.lit(minutes) if isinstance(minutes, int) else minutes) * 60_000


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def _minutes(text: Column, pattern: str, group: int, half: int) -> Column:
    """Minutes of a 12-hour clock from three groups: hour, minute (none is 0), half of the day."""
    pm = F.lower(F.regexp_extract(text, pattern, half)) == "pm"
    return (_number(text, pattern, group) % 12 + F.when(pm, 12).otherwise(0)) * 60 + F.coalesce(_number(text, pattern, group + 1), F.lit(0))


def range_instants(text: Column | str, zone: str) -> Column:
    """(start, end) in ms of ``Jul 26 - Aug 14, 2026``, ``Sep 26-27, 2026`` or ``Aug 04, 2026``: midnight and 23:59 in a zone.

    Hyphen or en dash, any case and spacing. A second month before the first is in the next
    year; an earlier day of the same month collapses to the start. What ends before it
    begins, and any other text, is null.
    """
    m = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    shape = rf"(?i)^{m}\s+(\d{{1,2}})(?:\s*[-–]\s*(?:{m}\s+)?(\d{{1,2}}))?,\s*(\d{{4}})\z"

    def parts(said: Column) -> Column:
        """Month, day and year of ``[month, day, second month, second day, year]``; what is not said is empty."""
        number = lambda i: F.nullif(F.get(said, F.lit(i)), F.lit("")).cast("int")
        first, other = month_number(F.get(said, F.lit(0))), F.get(said, F.lit(2))
        return F.struct(first.alias("m1"), number(1).alias("d1"), F.when(other != "", month_number(other)).alias("m2"), number(3).alias("d2"), number(4).alias("year"))

    def pair(p: Column) -> Column:
        before = F.when(p["m2"] < p["m1"], 1).otherwise(0)
        last = F.when(p["m2"].isNotNull(), p["d2"]).otherwise(F.greatest(p["d1"], p["d2"]))
        a = local_to_utc(utc_ms(p["year"] - before, p["m1"], p["d1"]), zone)
        b = local_to_utc(utc_ms(p["year"], F.coalesce(p["m2"], p["m1"]), last, 23 * 60 + 59), zone)
        return bound(F.struct(a.alias("start"), b.alias("end")), lambda r: F.when(r["end"] > r["start"], r))

    read = lambda t: F.when(t.rlike(shape), bound(bound(F.split(F.regexp_replace(t, shape, "$1|$2|$3|$4|$5"), r"\|"), parts), pair))
    return bound(F.trim(_col(text)), read)


def recovered_range(text: Column | str, anchor_ms: Column, zone: str) -> Column:
    """(start, end) in ms of the first clock range in prose, on the anchor's day in a zone; an end not after the start is the next day's."""
    t = _col(text)
    offset = zone_offset_minutes(anchor_ms, zone).cast("long") * 60_000
    day = F.floor((anchor_ms + offset) / DAY_MS) * DAY_MS
    start = local_to_utc(day + _minutes(t, TIME_RANGE, 1, 3).cast("long") * 60_000, zone)
    end = local_to_utc(day + _minutes(t, TIME_RANGE, 4, 6).cast("long") * 60_000, zone)
    return F.when(t.rlike(TIME_RANGE) & anchor_ms.isNotNull(), F.struct(start.alias("start"), F.when(end <= start, end + DAY_MS).otherwise(end).alias("end")))


def believed_schedule(start_ms: Column, end_ms: Column, text: Column | str, zone: str) -> Column:
    """(start, end, source): as stored where that is credible, else the clock in the text, else as stored and unverified."""
    from brightquay.functions.dates import suspect_schedule

    found = recovered_range(text, start_ms, zone)
    suspect = F.coalesce(suspect_schedule(start_ms, end_ms, zone), F.lit(False))
    of = lambda a, b, source: F.struct(a.alias("start"), b.alias("end"), F.lit(source).alias("source"))
    return F.when(start_ms.isNotNull(), F.when(~suspect, of(start_ms, end_ms, "stored")).when(found.isNotNull(), of(found["start"], found["end"], "description")).otherwise(of(start_ms, end_ms, "unverified")))


def instant_for(text: Column | str, zone: str, end_of_day: bool = False) -> Column:
    """(ms, date_only): a date alone, or midnight UTC, is that day's midnight (or 23:59) in a zone; else the instant."""
    t = _col(text)
    only = F.coalesce(t.rlike(DATE_ONLY), F.lit(False))
    day = utc_ms(F.substring(t, 1, 4).cast("int"), F.substring(t, 6, 2).cast("int"), F.substring(t, 9, 2).cast("int"), 23 * 60 + 59 if end_of_day else 0)
    return F.struct(F.when(only, local_to_utc(day, zone)).otherwise(F.unix_millis(F.try_to_timestamp(t))).alias("ms"), only.alias("date_only"))


def stated_instant(start: Column | str, end: Column | str) -> Column:
    """(start, end) in ms a page states: null for midnight in its own offset, which is a date marker; an end not later is the start."""
    a, b = F.unix_millis(F.try_to_timestamp(_col(start))), F.unix_millis(F.try_to_timestamp(F.coalesce(_col(end), _col(start))))
    return F.when(a.isNotNull() & ~_col(start).rlike(MIDNIGHT_IN_OWN_OFFSET), F.struct(a.alias("start"), F.greatest(a, F.coalesce(b, a)).alias("end")))


def whole_day_or_instant(start_ms: Column, end_ms: Column, zone: str) -> Column:
    """(date_only, start, end): seconds that no one states mark a date, which becomes its whole day in a zone."""
    only = F.pmod(F.floor(start_ms / 1000), F.lit(60)) != 0
    day = lambda ms: F.floor(ms / DAY_MS) * DAY_MS
    last = F.coalesce(end_ms, start_ms)
    return F.struct(only.alias("date_only"), F.when(only, local_to_utc(day(start_ms), zone)).otherwise(start_ms).alias("start"), F.when(only, local_to_utc(day(last) + DAY_MS - 60_000, zone)).otherwise(last).alias("end"))


def listed_range(text: Column | str, now_ms: Column, still_open: Column) -> Column:
    """(start, end) in ms of ``AUG 28 - SEP 4`` in a listing: from 7:00 UTC to 6:59 UTC after the last day.

    The year is this one; an end before the start is in the next. A range that is over
    belongs to the next year where the listing still calls it open.
    """
    t, year = _col(text), F.year(F.timestamp_millis(now_ms))
    m1 = month_number(F.regexp_extract(t, LISTED_RANGE, 1))
    m2 = F.when(F.regexp_extract(t, LISTED_RANGE, 3) == "", m1).otherwise(month_number(F.regexp_extract(t, LISTED_RANGE, 3)))
    d1, d2 = _number(t, LISTED_RANGE, 2), _number(t, LISTED_RANGE, 4)
    start = lambda y: utc_ms(y, m1, d1, 7 * 60)
    end = lambda y: utc_ms(y, m2, d2 + 1, 6 * 60 + 59)
    last = F.when(end(year) < start(year), end(year + 1)).otherwise(end(year))
    rolls = (last < now_ms) & still_open
    found = t.rlike(LISTED_RANGE) & (m1 > 0) & (m2 > 0)
    return F.when(found, F.struct(F.when(rolls, start(year + 1)).otherwise(start(year)).alias("start"), F.when(rolls, end(year + 1)).otherwise(last).alias("end")))


def card_range(month: Column, first: Column, last: Column, now_ms: Column, slack_days: int = 60) -> Column:
    """(start, end) in ms of a card with one month name and two days; a smaller last day is in the next month.

    A start more than ``slack_days`` ago is next year's. No last day means one day.
    """
    year, m = F.year(F.timestamp_millis(now_ms)), month_number(month)
    own = F.when(utc_ms(year, m, first) < now_ms - slack_days * DAY_MS, year + 1).otherwise(year)
    end_month = m + F.when(last < first, 1).otherwise(0)
    over = F.when(end_month > 12, 1).otherwise(0)
    end = utc_ms(own + over, end_month - 12 * over, F.coalesce(last, first) + 1, 6 * 60 + 59)
    return F.when((m > 0) & (first > 0), F.struct(utc_ms(own, m, first, 7 * 60).alias("start"), end.alias("end")))


def start_and_duration(text: Column | str, now_ms: Column) -> Column:
    """(start, end) in ms: the last full start in GMT before the duration marker, and its length; a start over by more than its length is next year's."""
    t = _col(text)
    shape = rf"(?i)\b({'|'.join(FULL_MONTHS)})\s+(\d{{1,2}}),\s*(\d{{1,2}}):(\d{{2}})\s*(AM|PM)\s*\(GMT\)"
    days, hours = _number(t, DURATION, 1), _number(t, DURATION, 2)
    at = F.element_at(F.regexp_extract_all(F.regexp_extract(t, r"(?is)^(.*?)Duration:", 1), F.lit(shape), F.lit(0)), F.lit(-1))
    last = F.get(F.filter(F.array(at), lambda x: x.isNotNull()), F.lit(0))
    length = (F.coalesce(days, F.lit(0)) * 24 + F.coalesce(hours, F.lit(0))).cast("long") * HOUR_MS
    year = F.year(F.timestamp_millis(now_ms))
    start = lambda y: utc_ms(y, month_number(F.regexp_extract(last, shape, 1)), _number(last, shape, 2), _minutes(last, shape, 3, 5))
    begin = F.when(start(year) + length < now_ms, start(year + 1)).otherwise(start(year))
    return F.when((days.isNotNull() | hours.isNotNull()) & last.isNotNull(), F.struct(begin.alias("start"), (begin + length).alias("end")))


def iso_offset_minutes(text: Column | str) -> Column:
    """Minutes of the offset that an ISO time carries; null without one."""
    t = F.trim(_col(text))
    shape = r"([+-])(\d{2}):(\d{2})\z"
    minutes = _number(t, shape, 2) * 60 + _number(t, shape, 3)
    return F.when(t.endswith("Z"), 0).when(t.rlike(shape), F.when(F.regexp_extract(t, shape, 1) == "-", -minutes).otherwise(minutes))


def timed_lines(start: Column | str, end: Column | str, zone: str) -> Column:
    """Two calendar lines: wall clocks in a zone where both stated offsets are the zone's own, else UTC."""
    a, b = _col(start), _col(end)
    ms = lambda x: F.unix_millis(F.try_to_timestamp(x))
    own = lambda x: F.coalesce(iso_offset_minutes(x) == zone_offset_minutes(ms(x), zone), F.lit(False))
    local = lambda x: F.regexp_replace(F.substring(x, 1, 19), "[-:]", "")
    utc = lambda x: F.concat(F.date_format(F.timestamp_millis(ms(x)), "yyyyMMdd'T'HHmmss"), F.lit("Z"))
    zoned = F.array(F.concat(F.lit(f"DTSTART;TZID={zone}:"), local(a)), F.concat(F.lit(f"DTEND;TZID={zone}:"), local(b)))
    return F.when(own(a) & own(b), zoned).otherwise(F.array(F.concat(F.lit("DTSTART:"), utc(a)), F.concat(F.lit("DTEND:"), utc(b))))


def iso_in_zone(ms: Column, zone: str) -> Column:
    """An instant as a wall clock of a zone with its offset, to the minute."""
    offset = zone_offset_minutes(ms, zone)
    wall = F.date_format(F.timestamp_millis(ms + offset.cast("long") * 60_000), "yyyy-MM-dd'T'HH:mm:'00'")
    size = F.abs(offset)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(wall, F.when(offset < 0, "-").otherwise("+"), two(F.floor(size / 60)), F.lit(":"), two(size % 60))


def stated_schedule(lines: Column, now_ms: Column, zone: str) -> Column:
    """(start, end, time_line) of the first date line with a time line behind it.

    Without a year, of the current year and the next those on whose stated weekday the date
    falls count: the first not more than 36 hours over, else the first at all, else this
    year. A labelled zone wins over the board's. An end month before the start's is next
    year's; an end not after the start is a day later.
    """
    offsets = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    this = F.year(F.timestamp_millis(now_ms + zone_offset_minutes(now_ms, zone).cast("long") * 60_000))

    def found(all_lines: Column) -> Column:
        here = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(all_lines) - 2))
        fits = lambda i: F.coalesce(F.get(all_lines, i).rlike(_DATE_LINE) & F.get(all_lines, i + 1).rlike(_TIME_LINE), F.lit(False))
        return bound(F.get(F.filter(here, fits), F.lit(0)), lambda at: F.struct(F.get(all_lines, at).alias("day"), F.get(all_lines, at + 1).alias("clock"), (at + 1).alias("time_line")))

    def parts(f: Column) -> Column:
        day, clock = f["day"], f["clock"]
        return F.struct(
            month_number(F.regexp_extract(day, _DATE_LINE, 2)).alias("month"), _number(day, _DATE_LINE, 3).alias("day"), F.regexp_extract(day, _DATE_LINE, 1).alias("weekday"), _number(day, _DATE_LINE, 4).alias("year"),
            _minutes(clock, _TIME_LINE, 1, 3).alias("opens"), _minutes(clock, _TIME_LINE, 6, 8).alias("closes"), F.nullif(F.regexp_extract(clock, _TIME_LINE, 4), F.lit("")).alias("end_month"), _number(clock, _TIME_LINE, 5).alias("end_day"),
            F.element_at(offsets, F.nullif(F.regexp_extract(clock, _TIME_LINE, 9), F.lit(""))).alias("offset"), f["time_line"].alias("time_line"), this.alias("this"),
        )

    def noons(x: Column) -> Column:
        """The parts, and of both years whether the date falls on the weekday and is not over."""
        noon = lambda y: utc_ms(y, x["month"], x["day"], 720)
        test = lambda y: bound(noon(y), lambda n: F.struct((F.date_format(F.timestamp_millis(n), "EEEE") == x["weekday"]).alias("fits"), (local_to_utc(n, zone) >= now_ms - 36 * HOUR_MS).alias("recent")))
        return F.struct(x.alias("x"), test(x["this"]).alias("a"), test(x["this"] + 1).alias("b"))

    def year_of(t: Column) -> Column:
        x, a, b = t["x"], t["a"], t["b"]
        inferred = F.when(a["fits"] & a["recent"], x["this"]).when(b["fits"] & b["recent"], x["this"] + 1).when(a["fits"], x["this"]).when(b["fits"], x["this"] + 1).otherwise(x["this"])
        return F.struct(x.alias("x"), F.coalesce(x["year"], inferred).alias("year"))

    def ends(t: Column) -> Column:
        x, year = t["x"], t["year"]
        instant = lambda wall: bound(wall, lambda ms: F.when(x["offset"].isNotNull(), ms - x["offset"].cast("long") * 60_000).otherwise(local_to_utc(ms, zone)))
        other = x["end_month"].isNotNull()
        last = bound(
            F.when(other, month_number(x["end_month"])).otherwise(x["month"]),
            lambda m: instant(utc_ms(year + F.when(m < x["month"], 1).otherwise(0), m, F.when(other, x["end_day"]).otherwise(x["day"]), x["closes"])),
        )
        return F.struct(instant(utc_ms(year, x["month"], x["day"], x["opens"])).alias("start"), last.alias("end"), x["time_line"].alias("time_line"))

    made = bound(bound(bound(bound(bound(bound(lines, found), parts), noons), year_of), ends), lambda r: F.struct(r["start"].alias("start"), F.when(r["end"] <= r["start"], r["end"] + DAY_MS).otherwise(r["end"]).alias("end"), r["time_line"].alias("time_line")))
    return bound(made, lambda r: F.when(r["time_line"].isNotNull(), r))
