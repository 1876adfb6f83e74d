"""The published board: records, order, summary, merging of duplicates, and what guards a publication."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import facts, scoring, stated, text
from brightquay.functions.dates import suspect_schedule
from brightquay.operators.gates import Regions
from brightquay.sources.files import exists


def published(notices: DataFrame, regions: Regions, now_ms: Column, zone: str, categories: Sequence[str]) -> DataFrame:
    """The published record of each notice, every column from one projection.

    Notices have ``url, title, evidence, category, held_because, confidence, via,
    checked_at, start_ms, end_ms, venue, city, online, availability, event_status,
    organizers, going``.
    """
    c = F.col
    n = notices.withColumn("_lines", facts.lines_of("evidence")).withColumn("_region", regions.region_of(c("city"), c("online")))
    n = n.withColumn("_prize", facts.prize("title", "evidence")).withColumn("_status", facts.status("evidence", c("_lines"), c("availability"), c("event_status")))
    n = n.withColumn("_area", regions.area_of(c("city"), c("_region"))).withColumn("_unverified", F.coalesce(suspect_schedule(c("start_ms"), c("end_ms"), zone), F.lit(False)))
    wall = lambda ms: ms + stated.zone_offset_minutes(ms, zone).cast("long") * 60_000
    n = n.withColumn("_said", facts.described(wall(c("start_ms")), wall(c("end_ms"))))
    n = n.withColumn("_builder", facts.builder_value(c("start_ms"), c("end_ms"), c("_prize.amount"), c("_prize.label"), "evidence"))
    n = n.withColumn("_access", facts.accessibility(c("_status"), regions.bonus(c("_region"), c("_area")))).withColumn("_fresh", scoring.freshness(c("start_ms"), now_ms))
    host = F.lower(text.url_part("url", "host"))
    return n.select(
        text.stable_event_id("url", own_hosts=("luma.com",)).alias("id"),
        "url",
        F.when(host == "luma.com", "luma").otherwise("external").alias("platform"),
        F.when(c("category") == "adjacent", "adjacent").otherwise("hackathon").alias("category"),
        F.when(c("category") == "adjacent", c("held_because")).alias("adjacent_reason"),
        "title",
        organizer(c("organizers"), c("_lines"), c("url")).alias("organizer"),
        F.when(~c("online"), c("venue")).alias("venue"),
        F.when(~c("online"), c("city")).alias("city"),
        c("_area").alias("area"),
        F.coalesce(c("_region"), F.lit(regions.all[0].key)).alias("region"),
        regions.label(c("_region")).alias("region_label"),
        stated.iso_in_zone(c("start_ms"), zone).alias("start"),
        stated.iso_in_zone(c("end_ms"), zone).alias("end"),
        F.lit(zone).alias("timezone"),
        c("_said.label").alias("date_label"),
        F.when(c("_unverified"), "Time on event page").otherwise(c("_said.detail")).alias("date_detail"),
        c("_unverified").alias("time_unverified"),
        c("_status").alias("status"),
        c("_prize.label").alias("prize"),
        facts.notice_tags(c("_lines"), c("title"), c("evidence"), categories).alias("tags"),
        F.coalesce(c("going"), text.going_count("evidence")).alias("going"),
        facts.why(c("start_ms"), c("end_ms"), c("_prize.label"), "evidence").alias("why"),
        scoring.final_score(c("confidence"), c("_builder"), c("_access"), c("_fresh")).alias("score"),
        "confidence",
        F.struct("confidence", c("_builder").alias("builder_value"), c("_access").alias("accessibility"), c("_fresh").alias("freshness")).alias("scores"),
        text.content_hash({"url": c("url"), "title": c("title"), "evidence": c("evidence")}).alias("content_sha256"),
        c("via").alias("discovered_via"),
        "checked_at",
    )


def organizer(structured: Column, lines: Column, url: Column) -> Column:
    """The first structured host, the line after either label, the site's name."""
    after = lambda label: F.when(F.array_position(lines, F.lit(label)) > 0, F.get(lines, F.array_position(lines, F.lit(label)).cast("int")))
    site = F.regexp_replace(F.lower(text.url_part(url, "host")), r"^www\.", "")
    return F.coalesce(F.nullif(F.get(structured, F.lit(0)), F.lit("")), after("Presented by"), after("Hosted By"), F.nullif(site, F.lit("")), F.lit("Unknown organizer"))


def publish_order(category: Column, score: Column, start: Column, ordinal: Column) -> list[Column]:
    """Sort keys: the format itself first, then score, start (none last) and input order."""
    return [F.when(category == "hackathon", 0).otherwise(1), F.desc(score), F.coalesce(start, F.lit("9999")), ordinal]


def board_meta(board: DataFrame, deleted: Column, redacted: Column) -> DataFrame:
    """One row of counts over a board."""
    return board.agg(
        F.count("*").alias("published"),
        F.count_if(F.col("category") == "hackathon").alias("hackathons"),
        F.count_if(F.col("category") == "adjacent").alias("adjacent"),
        F.countDistinct("organizer").alias("organizers"),
        F.countDistinct("discovered_via").alias("sources"),
        F.count_if(F.col("platform") == "external").alias("external"),
        F.count_if(deleted).alias("deleted"),
        F.count_if(redacted).alias("redacted"),
    )


def resolvers(notices: DataFrame, regions: Regions, zone: str) -> DataFrame:
    """``day, host, area`` as two notices are compared by: local day, organizer in bare letters (unknown is empty), area of the city or of the text."""
    c = F.col
    lines = facts.lines_of("evidence")
    name = organizer(c("organizers"), lines, c("url"))
    place = F.coalesce(F.nullif(c("city"), F.lit("")), F.nullif(F.regexp_extract("evidence", regions.places, 0), F.lit("")))
    wall = c("start_ms") + stated.zone_offset_minutes(c("start_ms"), zone).cast("long") * 60_000
    host = F.when(name == "Unknown organizer", "").otherwise(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")))
    area = F.when(place.isNull(), "").otherwise(regions.area_of(place, F.lit(None).cast("string")))
    return notices.withColumn("day", F.date_format(F.timestamp_millis(wall), "yyyy-MM-dd")).withColumn("host", host).withColumn("area", area)


def merged_duplicate(a: Column, b: Column, zone: str) -> Column:
    """One record of two (``url, confidence, start_ms, end_ms, time_source, venue, evidence`` structs), a found first.

    The platform's own record is the base, else the more confident one, else ``a``. The
    base takes the other's schedule only where its own is not credible, its venue where it
    has none, and its evidence behind its own where that is longer.
    """
    own = lambda x: x["url"].startswith("https://luma.com/")
    swap = (own(b) & ~own(a)) | ((own(a) == own(b)) & (F.coalesce(b["confidence"], F.lit(0)) > F.coalesce(a["confidence"], F.lit(0))))
    base, other = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    credible = lambda x: x["start_ms"].isNotNull() & ~F.coalesce(suspect_schedule(x["start_ms"], x["end_ms"], zone), F.lit(False))
    takes = ~credible(base) & credible(other)
    longer = F.length(F.coalesce(other["evidence"], F.lit(""))) > F.length(F.coalesce(base["evidence"], F.lit("")))
    return F.struct(
        base["url"].alias("url"),
        base["confidence"].alias("confidence"),
        F.when(takes, other["start_ms"]).otherwise(base["start_ms"]).alias("start_ms"),
        F.when(takes, other["end_ms"]).otherwise(base["end_ms"]).alias("end_ms"),
        F.when(takes, F.concat(F.coalesce(other["time_source"], F.lit("other")), F.lit("-via-duplicate"))).otherwise(base["time_source"]).alias("time_source"),
        F.coalesce(base["venue"], other["venue"]).alias("venue"),
        F.when(longer, F.concat_ws("\n", base["evidence"], other["evidence"])).otherwise(base["evidence"]).alias("evidence"),
    )


def keep_highest(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """Per key the row with the highest value, the first of equals."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(value, -F.col(ordinal))).alias("_r")).select(key, "_r.*")


def first_of(rows: DataFrame, identity: Sequence[str], ordinal: str) -> DataFrame:
    """The first row of each composite identity; a missing part is a value of its own."""
    rest = [c for c in rows.columns if c not in identity]
    return rows.groupBy(*identity).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(*identity, "_r.*")


def fresher_maps(older: Column, newer: Column) -> Column:
    """Union of two maps; the newer side's value wins."""
    return F.map_concat(F.map_filter(older, lambda k, _: ~F.map_contains_key(newer, k)), newer)


def with_context_first(rows: DataFrame, key: str, context: str, ordinal: str) -> DataFrame:
    """Per key the first row that has a context, else the last row at all."""
    rest = [c for c in rows.columns if c != key]
    rank = F.struct(F.col(context).isNull(), F.when(F.col(context).isNull(), -F.col(ordinal)).otherwise(F.col(ordinal)))
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(key, "_r.*")


def feed_collapsed(counts: DataFrame, floor: int = 100, share: float = 0.5) -> DataFrame:
    """``previous, now`` rows with ``collapsed`` and the numbers that ``stand``: those of before where the feed fell below its floor."""
    collapsed = (F.col("previous") > 0) & (F.col("now") < F.greatest(F.lit(floor), F.ceil(F.col("previous") * share)))
    return counts.withColumn("collapsed", collapsed).withColumn("stands", F.when(collapsed, F.col("previous")).otherwise(F.col("now")))


def merged_after_collapse(previous: DataFrame, current: DataFrame, found: DataFrame, collapsed: bool, key: str = "url") -> DataFrame:
    """This run's rows, and on a collapse the previous ones that its other passes have not found again."""
    return current.unionByName(previous.join(found.select(key), key, "left_anti")) if collapsed else current


def stay_alive(previous: DataFrame, current: DataFrame, problems: int, queries: int, now_ms: Column) -> DataFrame:
    """When every query failed, the previous rows that are not over; else this run's."""
    return previous.filter(F.coalesce(F.col("end_ms") >= now_ms, F.lit(True))) if queries and problems >= queries else current


def write_tombstones(stones: DataFrame, path: str, per_file: int = 1000) -> None:
    """Tombstones as objects with a list, about ``per_file`` in each file of a folder."""
    pieces = max(1, math.ceil(stones.count() / per_file))
    lists = stones.groupBy(F.pmod(F.xxhash64("url"), F.lit(pieces)).alias("piece")).agg(F.collect_list(F.struct(*stones.columns)).alias("tombstones"))
    lists.select("tombstones").write.option("maxRecordsPerFile", 1).json(path)


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """Tombstones of a file; no file is none, and a file that cannot be read stops the publication."""
    schema = "url string, id string, action string, fields array<string>, reason string, redactedAt string, contentSha256 string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lists = f"tombstones array<struct<{schema}>>"
    if spark.read.schema(f"{lists}, _corrupt_record string").option("multiLine", True).json(path).filter("tombstones IS NULL OR _corrupt_record IS NOT NULL").limit(1).count():
        raise ValueError(f"{path}: no list of tombstones")
    whole = spark.read.schema(lists).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode("tombstones").alias("t")).select("t.*")


def check_fall(previous: int, now: int, floor: int, share: float = 0.5) -> bool:
    """Whether a count fell below the floor or the share of one that was not empty."""
    return previous > 0 and now < max(floor, math.ceil(previous * share))


def surfaces_of(row_url: str, **surfaces: DataFrame) -> DataFrame:
    """``surface, n``: where a record still shows, for a proof of its deletion."""
    out = None
    for name, df in surfaces.items():
        one = df.agg(F.count_if(F.col("url") == row_url).alias("n")).select(F.lit(name).alias("surface"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def drifted(board: DataFrame, calendar: DataFrame, least_ms: int = 60_000, prefix: int = 12) -> DataFrame:
    """``id, board_ms, calendar_ms`` of board rows whose calendar entry starts at another time.

    Titles are compared in bare letters: equal ones first, the calendar's last entry of a
    title counting; else one title begins with the other, the longest calendar title first.
    Beginnings of ``prefix`` letters and more are rows of their own and meet the titles in
    equi-joins, so the work grows with titles times their length, however many begin alike.
    A calendar title that goes on behind the board's is longer than any it begins with.
    """
    key = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    stored = calendar.withColumn("_key", key(F.col("title"))).filter("_key <> ''").groupBy("_key").agg(F.max_by("start_ms", "ordinal").alias("_at"))
    own = board.filter("start_ms IS NOT NULL").withColumn("_own", key(F.col("title")))
    equal = own.join(stored, F.col("_own") == F.col("_key"), "left")
    matched = equal.filter("_at IS NOT NULL").select("id", F.col("start_ms").alias("board_ms"), F.col("_at").alias("calendar_ms"))
    rest = equal.filter("_at IS NULL").select("id", "start_ms", "_own").filter(F.length("_own") >= prefix)
    own_titles, near = rest.select("_own").distinct(), stored.filter(F.length("_key") >= prefix)
    begins = lambda c: F.explode(F.transform(F.sequence(F.lit(prefix), F.greatest(F.lit(prefix), F.length(c) - 1)), lambda i: F.substr(F.col(c), F.lit(1), i)))
    best = lambda at: F.max_by(at, F.struct(F.length("_key"), F.col("_key")))
    of_title = best(F.struct("_key", "_at")).alias("_best")
    longer = near.filter(F.length("_key") > prefix).select(begins("_key").alias("_own"), "_key", "_at").join(own_titles.hint("merge"), "_own", "left_semi").groupBy("_own").agg(of_title)
    shorter = own_titles.filter(F.length("_own") > prefix).select("_own", begins("_own").alias("_key")).join(near.hint("merge"), "_key").groupBy("_own").agg(of_title)
    held = longer.unionByName(shorter).select("_own", "_best.*")
    begun = rest.join(held.hint("merge"), "_own").groupBy("id", "start_ms").agg(best("_at").alias("calendar_ms"))
    every = matched.unionByName(begun.select("id", F.col("start_ms").alias("board_ms"), "calendar_ms"))
    return every.filter(F.abs(F.col("calendar_ms") - F.col("board_ms")) >= least_ms)


def seed_review(passes: DataFrame, swept_ms: Column, window_ms: int = 7_200_000) -> DataFrame:
    """``label, severity, message`` of seed passes (``label, collected_ms, queries, problems, misconfigured, tracked``).

    A pass that ended well before the sweep did not run with it and is a note alone; one
    that ran is a failure when misconfigured, a warning when all its queries failed or it
    tracks nothing, and a note in any case.
    """
    ran = F.col("collected_ms").isNull() | swept_ms.isNull() | (swept_ms - F.col("collected_ms") < window_ms)
    fail = F.when(F.col("misconfigured") > 0, F.struct(F.lit("failure").alias("severity"), F.lit("misconfigured").alias("message")))
    warn = F.when((F.col("queries") > 0) & (F.col("problems") >= F.col("queries")), F.struct(F.lit("warning").alias("severity"), F.lit("all queries failed").alias("message"))).when(F.col("tracked") == 0, F.struct(F.lit("warning").alias("severity"), F.lit("no seeds").alias("message")))
    note = F.struct(F.lit("note").alias("severity"), F.when(ran, "ran").otherwise("not run").alias("message"))
    rows = F.filter(F.array(F.when(ran, F.coalesce(fail, warn)), note), lambda r: r.isNotNull())
    return passes.select("label", F.explode(rows).alias("r")).select("label", "r.*")
