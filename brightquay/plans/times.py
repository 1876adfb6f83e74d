"""Queries over stated times: written out of whole orders by SQL that both engines read, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import facts, stated
from brightquay.plans.board import table

ZONE = "America/Los_Angeles"
#: 2000-07-01 in UTC: half of a year's ranges are over.
NOW = 962_409_600_000

_PICK = lambda x, names: f"CASE {x} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
_TWO = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
WRITTEN = f"""
SELECT *, {_PICK('m - 1', [m[:3] for m in stated.FULL_MONTHS])} AS mon, {_PICK('m - 1', stated.FULL_MONTHS)} AS month, {_PICK('(CAST(floor(ms / 86400000) AS BIGINT) + 4) % 7', 'Sunday Monday Tuesday Wednesday Thursday Friday Saturday'.split())} AS weekday,
  CAST(y AS STRING) || '-' || {_TWO('m')} || '-' || {_TWO('d')} AS iso
FROM (SELECT o_orderkey AS id, $MS AS ms, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(o_custkey % 20 AS INT) AS e FROM $ORDERS) w
"""
TEXTS = """
SELECT id, ms, y, m, d, e, weekday, iso,
  CASE id % 6 WHEN 0 THEN mon || ' ' || CAST(d AS STRING) || ', ' || CAST(y AS STRING) WHEN 1 THEN lower(mon) || '  ' || CAST(d AS STRING) || '–' || CAST(d + e AS STRING) || ', ' || CAST(y AS STRING)
    WHEN 2 THEN upper(mon) || ' ' || CAST(d AS STRING) || ' - Mar ' || CAST(e + 1 AS STRING) || ',' || CAST(y AS STRING) WHEN 3 THEN mon || ' 20 - ' || mon || ' 10, ' || CAST(y AS STRING)
    WHEN 4 THEN mon || ' 20 - 10, ' || CAST(y AS STRING) ELSE 'coming soon' END AS ranged,
  CASE id % 5 WHEN 0 THEN 'Doors from 9am-6pm daily' WHEN 1 THEN '12:30 pm to 1:15 PM' WHEN 2 THEN 'we build 10pm until 4 am' WHEN 3 THEN '8:05 AM — 11 am sharp' ELSE 'all day' END AS prose,
  CASE id % 4 WHEN 0 THEN 'LIVE ' || upper(mon) || ' ' || CAST(d AS STRING) || ' - ' || CAST(d + e AS STRING) || ' now' WHEN 1 THEN upper(mon) || ' ' || CAST(d AS STRING) || ' – JAN ' || CAST(e + 1 AS STRING) WHEN 2 THEN upper(mon) || ' ' || CAST(d AS STRING) || '-DEC ' || CAST(e + 1 AS STRING) ELSE 'TBA' END AS listed,
  'Closes January 1, 1:00 AM (GMT) ' || CASE WHEN id % 7 > 0 THEN 'Starts ' || month || ' ' || CAST(d AS STRING) || ', ' || CAST(1 + e % 12 AS STRING) || ':30 ' || CASE WHEN e % 2 = 0 THEN 'AM' ELSE 'PM' END || ' (GMT) ' ELSE '' END
    || CASE id % 5 WHEN 0 THEN 'no end' WHEN 1 THEN 'Duration: 9 Days, 22 Hours' WHEN 2 THEN 'Duration: ' || CAST(e + 1 AS STRING) || ' Days' ELSE 'duration: 5 hours' END AS engaged,
  CASE id % 4 WHEN 0 THEN iso WHEN 1 THEN iso || 'T00:00:00Z' WHEN 2 THEN iso || 'T00:00:00-05:00' ELSE iso || 'T1' || CAST(e % 10 AS STRING) || ':15:00+02:00' END AS dated,
  iso || 'T1' || CAST(e % 10 AS STRING) || ':30:00' || CASE id % 3 WHEN 0 THEN '-08:00' WHEN 1 THEN '-07:00' ELSE 'Z' END AS timed,
  'Intro' || chr(10) || CASE WHEN id % 9 = 0 THEN 'no date' ELSE weekday || ', ' || month || ' ' || CAST(d AS STRING) || CASE WHEN id % 2 = 0 THEN ', ' || CAST(y AS STRING) ELSE '' END END || chr(10)
    || CASE id % 4 WHEN 0 THEN '9:00 AM - 5:30 PM' WHEN 1 THEN '10:15 PM - 2:00 AM PST' WHEN 2 THEN '9:00 AM - Jan 3, 6:00 PM EST' ELSE '12:00 AM - 12:30 PM' END || chr(10) || 'Hall' AS page
FROM ($WRITTEN) x
"""
_DUCK = TEXTS.replace("$WRITTEN", WRITTEN).replace("$MS", "epoch_ms(o_orderdate)").replace("$ORDERS", "orders")
T = f"t AS ({_DUCK})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written out, a row per order."""
    ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))"
    return spark.sql(TEXTS.replace("$WRITTEN", WRITTEN).replace("$MS", ms).replace("$ORDERS", "{orders}"), orders=table(spark, sf_dir, "orders"))


_DAY = lambda y, m, d: f"(make_date({y}, {m}, 1) + CAST({d} - 1 AS INT))"
_LOCAL = lambda ts: f"epoch_ms(timezone('{ZONE}', CAST({ts} AS TIMESTAMP)))"
_UTC = lambda ts: f"epoch_ms(CAST({ts} AS TIMESTAMP))"


def stated_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges with a year, as instants in the board's zone."""
    return texts(spark, sf_dir).withColumn("r", stated.range_instants("ranged", ZONE)).select("id", "r.start", "r.end")


STATED_RANGES = f"""
WITH {T}, d AS (SELECT id, CASE id % 6 WHEN 0 THEN {_DAY('y', 'm', 'd')} WHEN 1 THEN {_DAY('y', 'm', 'd')} WHEN 2 THEN {_DAY('CASE WHEN m > 3 THEN y - 1 ELSE y END', 'm', 'd')} WHEN 4 THEN {_DAY('y', 'm', '20')} END AS a,
  CASE id % 6 WHEN 0 THEN {_DAY('y', 'm', 'd')} WHEN 1 THEN {_DAY('y', 'm', 'd + e')} WHEN 2 THEN {_DAY('y', '3', 'e + 1')} WHEN 4 THEN {_DAY('y', 'm', '20')} END AS b FROM t)
SELECT id, CASE WHEN b >= a THEN {_LOCAL('a')} END AS start, CASE WHEN b >= a THEN {_LOCAL("CAST(b AS TIMESTAMP) + INTERVAL 1439 MINUTE")} END AS "end" FROM d
"""


def recovered_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks in prose on an anchor's day, and which schedule is believed."""
    t = texts(spark, sf_dir).withColumn("anchor", F.col("ms") + (F.col("e") + 1) * 3_600_000)
    t = t.withColumn("r", stated.recovered_range("prose", F.col("anchor"), ZONE)).withColumn("s", stated.believed_schedule(F.col("anchor"), F.col("anchor") + 7_200_000, "prose", ZONE))
    return t.select("id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("s.start").alias("believed"), F.col("s.source").alias("source"))


RECOVERED_CLOCKS = f"""
WITH {T}, a AS (SELECT *, ms + (e + 1) * 3600000 AS anchor FROM t), l AS (SELECT *, timezone('{ZONE}', make_timestamptz(anchor * 1000)) AS w, CASE id % 5 WHEN 0 THEN 540 WHEN 1 THEN 750 WHEN 2 THEN 1320 WHEN 3 THEN 485 END AS p, CASE id % 5 WHEN 0 THEN 1080 WHEN 1 THEN 795 WHEN 2 THEN 240 WHEN 3 THEN 660 END AS q FROM a),
s AS (SELECT *, {_LOCAL("CAST(CAST(w AS DATE) AS TIMESTAMP) + to_minutes(p)")} AS start, {_LOCAL("CAST(CAST(w AS DATE) AS TIMESTAMP) + to_minutes(q)")} AS e0 FROM l),
r AS (SELECT *, CASE WHEN e0 <= start THEN e0 + 86400000 ELSE e0 END AS "end" FROM s)
SELECT id, start, "end", CASE WHEN hour(w) < 6 AND start IS NOT NULL THEN start ELSE anchor END AS believed, CASE WHEN hour(w) >= 6 THEN 'stored' WHEN start IS NOT NULL THEN 'description' ELSE 'unverified' END AS source FROM r
"""


def listed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges without a year in listings and on cards."""
    t = texts(spark, sf_dir)
    t = t.withColumn("r", stated.listed_range("listed", F.lit(NOW), F.col("id") % 2 == 0)).withColumn("k", stated.card_range(F.lit("October"), F.col("d"), F.when(F.col("id") % 3 > 0, F.col("e") + 1), F.lit(NOW)))
    return t.select("id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("k.start").alias("card_start"), F.col("k.end").alias("card_end"))


_END = lambda y: f"CASE id % 4 WHEN 0 THEN {_DAY(y, 'm', 'd + e + 1')} WHEN 1 THEN {_DAY(y, '1', 'e + 2')} WHEN 2 THEN {_DAY(y, '12', 'e + 2')} END"
LISTED_RANGES = f"""
WITH {T}, a AS (SELECT *, CASE WHEN id % 4 < 3 THEN {_UTC(_DAY('2000', 'm', 'd'))} + 25200000 END AS s0, CASE WHEN id % 4 < 3 THEN {_UTC(_DAY('2001', 'm', 'd'))} + 25200000 END AS s1, {_UTC(_END('2000'))} + 25140000 AS e0, {_UTC(_END('2001'))} + 25140000 AS e1 FROM t),
b AS (SELECT *, CASE WHEN e0 < s0 THEN e1 ELSE e0 END AS last FROM a),
c AS (SELECT *, last < {NOW} AND id % 2 = 0 AS rolls, CASE WHEN id % 3 > 0 THEN e + 1 END AS z FROM b)
SELECT id, CASE WHEN rolls THEN s1 ELSE s0 END AS start, CASE WHEN rolls THEN e1 ELSE last END AS "end", {_UTC(_DAY('2000', '10', 'd'))} + 25200000 AS card_start,
  {_UTC(_DAY('2000', 'CASE WHEN z < d THEN 11 ELSE 10 END', 'coalesce(z, d) + 1'))} + 25140000 AS card_end FROM c
"""


def engage_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last start before a duration, and its end."""
    return texts(spark, sf_dir).withColumn("r", stated.start_and_duration("engaged", F.lit(NOW))).select("id", "r.start", "r.end")


ENGAGE_DATES = f"""
WITH {T}, a AS (SELECT *, CASE id % 5 WHEN 1 THEN 238 WHEN 2 THEN 24 * (e + 1) WHEN 0 THEN NULL ELSE 5 END * 3600000 AS len, CASE WHEN id % 7 > 0 THEN m ELSE 1 END AS mm, CASE WHEN id % 7 > 0 THEN d ELSE 1 END AS dd,
  CASE WHEN id % 7 > 0 THEN ((1 + e % 12) % 12 + CASE WHEN e % 2 = 0 THEN 0 ELSE 12 END) * 60 + 30 ELSE 60 END * 60000 AS clock FROM t),
b AS (SELECT *, {_UTC(_DAY('2000', 'mm', 'dd'))} + clock AS s0, {_UTC(_DAY('2001', 'mm', 'dd'))} + clock AS s1 FROM a), c AS (SELECT id, len, CASE WHEN s0 + len < {NOW} THEN s1 ELSE s0 END AS s FROM b)
SELECT id, CASE WHEN len IS NOT NULL THEN s END AS start, s + len AS "end" FROM c
"""


def dated_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that look like instants, by three sources' rules."""
    t = texts(spark, sf_dir).withColumn("i", stated.instant_for("dated", ZONE)).withColumn("z", stated.instant_for("dated", ZONE, end_of_day=True)).withColumn("s", stated.stated_instant("dated", F.lit(None).cast("string")))
    t = t.withColumn("w", stated.whole_day_or_instant(F.col("ms") + (F.col("e") % 3) * 1000, F.col("ms") + F.col("e") * 3_600_000, ZONE))
    return t.select("id", F.col("i.ms").alias("first"), F.col("z.ms").alias("last"), F.col("i.date_only").alias("only"), F.col("s.start").alias("stated"), F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"))


DATED_INSTANTS = f"""
WITH {T}, a AS (SELECT *, CAST(iso AS DATE) AS day, CASE id % 4 WHEN 2 THEN {_UTC('iso')} + 18000000 WHEN 3 THEN {_UTC('iso')} + (10 + e % 10) * 3600000 + 900000 - 7200000 END AS inst, e % 3 > 0 AS junk FROM t)
SELECT id, CASE WHEN id % 4 < 2 THEN {_LOCAL('day')} ELSE inst END AS first, CASE WHEN id % 4 < 2 THEN {_LOCAL('CAST(day AS TIMESTAMP) + INTERVAL 1439 MINUTE')} ELSE inst END AS last, id % 4 < 2 AS only,
  CASE id % 4 WHEN 0 THEN {_UTC('day')} WHEN 3 THEN inst END AS stated, CASE WHEN junk THEN {_LOCAL('day')} ELSE ms END AS day_start,
  CASE WHEN junk THEN {_LOCAL('CAST(CAST(make_timestamp((ms + e * 3600000) * 1000) AS DATE) AS TIMESTAMP) + INTERVAL 1439 MINUTE')} ELSE ms + e * 3600000 END AS day_end FROM a
"""


def timed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar lines in the zone where the stated offset is its own, else in UTC."""
    t = texts(spark, sf_dir).withColumn("l", stated.timed_lines("timed", "timed", ZONE))
    return t.select("id", F.get("l", F.lit(0)).alias("start"), F.get("l", F.lit(1)).alias("end"), stated.iso_offset_minutes("timed").alias("offset"), stated.iso_in_zone(F.col("ms"), ZONE).alias("local"))


TIMED_ENTRIES = f"""
WITH {T}, a AS (SELECT *, CASE id % 3 WHEN 0 THEN -480 WHEN 1 THEN -420 ELSE 0 END AS o, CAST(substr(timed, 1, 19) AS TIMESTAMP) AS w FROM t),
b AS (SELECT *, w - to_minutes(o) AS u FROM a), c AS (SELECT *, date_diff('minute', u, timezone('{ZONE}', timezone('UTC', u))) = o AS own, timezone('{ZONE}', make_timestamptz(ms * 1000)) AS l FROM b),
d AS (SELECT id, o, l, ms, CASE WHEN own THEN ';TZID={ZONE}:' || strftime(w, '%Y%m%dT%H%M%S') ELSE ':' || strftime(u, '%Y%m%dT%H%M%S') || 'Z' END AS x FROM c)
SELECT id, 'DTSTART' || x AS start, 'DTEND' || x AS "end", o AS "offset", strftime(l, '%Y-%m-%dT%H:%M:00') || '-0' || (-date_diff('minute', make_timestamp(ms * 1000), l) // 60) || ':00' AS local FROM d
"""


def page_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date line and time line, with years inferred by weekday and zones by label."""
    return texts(spark, sf_dir).withColumn("s", stated.stated_schedule(facts.lines_of("page"), F.lit(NOW), ZONE)).select("id", "s.start", "s.end", F.col("s.time_line").cast("int").alias("line"))


_SHIFT = lambda ts, label: f"CASE WHEN {label} IS NULL THEN {_LOCAL(ts)} ELSE {_UTC(ts)} - {label} * 60000 END"
PAGE_SCHEDULES = f"""
WITH {T}, f AS (SELECT *, dayname({_DAY('2000', 'm', 'd')}) = weekday AS f0, dayname({_DAY('2001', 'm', 'd')}) = weekday AS f1, {_LOCAL(f"CAST({_DAY('2000', 'm', 'd')} AS TIMESTAMP) + INTERVAL 12 HOUR")} >= {NOW - 129_600_000} AS r0, {_LOCAL(f"CAST({_DAY('2001', 'm', 'd')} AS TIMESTAMP) + INTERVAL 12 HOUR")} >= {NOW - 129_600_000} AS r1 FROM t WHERE id % 9 > 0),
g AS (SELECT id, m, d, CASE WHEN id % 2 = 0 THEN y WHEN f0 AND r0 THEN 2000 WHEN f1 AND r1 THEN 2001 WHEN f0 THEN 2000 WHEN f1 THEN 2001 ELSE 2000 END AS yy, CASE id % 4 WHEN 1 THEN -480 WHEN 2 THEN -300 END AS z,
  CASE id % 4 WHEN 0 THEN 540 WHEN 1 THEN 1335 WHEN 2 THEN 540 ELSE 0 END AS p, CASE id % 4 WHEN 0 THEN 1050 WHEN 1 THEN 120 WHEN 2 THEN 1080 ELSE 750 END AS q FROM f),
h AS (SELECT id, {_SHIFT(f"(CAST({_DAY('yy', 'm', 'd')} AS TIMESTAMP) + to_minutes(p))", 'z')} AS s, CASE WHEN id % 4 = 2 THEN {_SHIFT("(CAST(make_date(yy + CASE WHEN m > 1 THEN 1 ELSE 0 END, 1, 3) AS TIMESTAMP) + to_minutes(q))", 'z')} ELSE {_SHIFT(f"(CAST({_DAY('yy', 'm', 'd')} AS TIMESTAMP) + to_minutes(q))", 'z')} END AS e FROM g)
SELECT id, s AS start, CASE WHEN e <= s THEN e + 86400000 ELSE e END AS "end", 2 AS line FROM h UNION ALL SELECT id, NULL, NULL, NULL FROM t WHERE id % 9 = 0
"""

QUERIES = {
    "stated_ranges": (stated_ranges, STATED_RANGES),
    "recovered_clocks": (recovered_clocks, RECOVERED_CLOCKS),
    "listed_ranges": (listed_ranges, LISTED_RANGES),
    "engage_dates": (engage_dates, ENGAGE_DATES),
    "dated_instants": (dated_instants, DATED_INSTANTS),
    "timed_entries": (timed_entries, TIMED_ENTRIES),
    "page_schedules": (page_schedules, PAGE_SCHEDULES),
}
