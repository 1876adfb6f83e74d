"""Gates: which notices are published, held for review or dropped, and why."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import facts
from brightquay.functions.dates import zone_offset_minutes

#: Least confidence of what is published, and of what is recorded as a near miss.
CONFIDENCE_BAR, NEAR_MISS_FLOOR = 54, 45
_ONLINE = r"(?i)^(online|virtual|remote)(?:[\s-]*(?:event|only|hackathon))?\z"


@dataclass(frozen=True)
class Region:
    """A served region: its cities by area, the states it lies in, its zone and the areas' bonuses."""

    key: str
    label: str
    zone: str
    states: tuple[str, ...] = ()
    areas: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    core_area: str | None = None
    bonus: Mapping[str, int] = field(default_factory=dict)
    online: bool = False


class Regions:
    """All served regions, the default first; a configuration, so lookups are literals."""

    def __init__(self, *regions: Region):
        self.all = regions
        self.cities = {c.lower(): (r, a) for r in reversed(regions) for a, cs in r.areas.items() for c in cs}
        self.online = next((r.key for r in regions if r.online), None)
        self.places = facts.place_pattern(self.cities)

    def table(self, spark: SparkSession) -> DataFrame:
        """``region, label, zone, core_area, area, city, bonus``: the configuration as a dimension."""
        rows = [(r.key, r.label, r.zone, r.core_area, a, c.lower(), r.bonus.get(a)) for r in self.all for a, cs in r.areas.items() for c in cs]
        return spark.createDataFrame(rows, "region string, label string, zone string, core_area string, area string, city string, bonus int")

    def _by_city(self, city: Column, value) -> Column:
        pairs = [F.lit(x) for c, (r, a) in self.cities.items() for x in (c, value(r, a))]
        return F.element_at(F.create_map(*pairs), F.lower(F.trim(city)))

    def _by_key(self, key: Column, value) -> Column:
        pairs = [F.lit(x) for r in self.all for x in (r.key, value(r))]
        return F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit(self.all[0].key)))

    def is_online(self, name: Column, flag: Column | None = None) -> Column:
        """The flag, or a place that is named online."""
        named = F.coalesce(F.trim(name).rlike(_ONLINE), F.lit(False))
        return named if flag is None else F.coalesce(flag, F.lit(False)) | named

    def region_of(self, city: Column, online: Column) -> Column:
        """Key of the region: the online one, else that of a served city, else null."""
        by_city = self._by_city(city, lambda r, a: r.key)
        return F.when(online, F.lit(self.online)).otherwise(by_city) if self.online else by_city

    def area_of(self, city: Column, region: Column) -> Column:
        """A served city's area, else the region's label."""
        return F.coalesce(self._by_city(city, lambda r, a: a), self.label(region))

    def label(self, key: Column) -> Column:
        """Label of a region, of the default for null."""
        return self._by_key(key, lambda r: r.label)

    def core(self, key: Column) -> Column:
        """Core area of a region."""
        return F.nullif(self._by_key(key, lambda r: r.core_area or ""), F.lit(""))

    def bonus(self, key: Column, area: Column) -> Column:
        """An area's bonus in its region; null where it has none."""
        pairs = [F.lit(x) for r in self.all for a, b in r.bonus.items() for x in (f"{r.key}/{a}", b)]
        return F.element_at(F.create_map(*pairs), F.concat_ws("/", F.coalesce(key, F.lit(self.all[0].key)), area))

    def unserved(self, state: Column) -> Column:
        """A state is named, and no region lies in it."""
        own = F.lower(F.trim(F.coalesce(state, F.lit(""))))
        return (own != "") & ~own.isin(sorted({s.lower() for r in self.all for s in r.states}))

    def serves_offset(self, start_ms: Column, minutes: Column) -> Column:
        """Some region's zone has the stated offset at the instant."""
        zones = F.array(*[zone_offset_minutes(start_ms, z) for z in sorted({r.zone for r in self.all})])
        return F.exists(zones, lambda z: z == minutes)

    def resolve_city(self, text: Column) -> Column:
        """The first comma part that is a served city, as written; else the first served place in the text, titled."""
        parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda p: F.lower(p).isin(sorted(self.cities)))
        return F.coalesce(F.get(parts, F.lit(0)), F.nullif(facts.titled(F.regexp_extract(F.coalesce(text, F.lit("")), self.places, 0)), F.lit("")))


def first_true(*tests: tuple[Column, str]) -> Column:
    """Name of the first test that holds; null when none does. An unknown test does not hold."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in tests])


def schedule_drop(start_ms: Column, end_ms: Column, swept_ms: Column, now_ms: Column) -> Column:
    """Why a notice's schedule keeps it from the board: none at all, or over by the later of sweep and now."""
    return first_true((start_ms.isNull() | end_ms.isNull(), "no schedule"), (end_ms < F.greatest(swept_ms, now_ms), "over"))


def region_drop(regions: Regions, city: Column, state: Column, name: Column, start_ms: Column, offset_minutes: Column) -> Column:
    """Why a notice's place keeps it from the board: a named city, a stated state, or a stated offset that no region has."""
    online = regions.is_online(name)
    region = regions.region_of(city, online)
    return first_true(
        ((F.trim(F.coalesce(city, F.lit(""))) != "") & region.isNull(), "city"),
        (regions.unserved(state), "state"),
        (region.isNull() & ~online & offset_minutes.isNotNull() & ~regions.serves_offset(start_ms, offset_minutes), "offset"),
    )


def placeholder(title: Column) -> Column:
    """A stand-in for a venue, no event."""
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).startswith("venue placeholder -")


def in_view(view: Column, category: Column, status: Column, prize: Column, area: Column, core_area: Column, title: Column) -> Column:
    """Whether a row is in the view ``hackathons`` (no placeholders), ``open``, ``prizes`` or ``city``; any other shows everything."""
    return (
        F.when(view == "hackathons", (category == "hackathon") & ~placeholder(title))
        .when(view == "open", status.isin("Open", "Approval"))
        .when(view == "prizes", prize.contains("$"))
        .when(view == "city", area.eqNullSafe(core_area))
        .otherwise(F.lit(True))
    )


def found_by(needle: Column, title: Column, organizer: Column, tags: Column, city: Column) -> Column:
    """Rows whose title, organizer, tags and city hold the trimmed needle, in any case."""
    where = F.lower(F.concat_ws(" ", title, organizer, F.array_join(tags, " "), F.coalesce(city, F.lit(""))))
    return where.contains(F.lower(F.trim(needle)))


def publish_label(confidence: Column, local: Column, kind: Column, index_source: Column, past: Column, negative: Column, competes: Column, named: Column) -> Column:
    """(label, reason) of a page: hackathon, adjacent with its reason, near miss, or none.

    ``negative``: the title names another format; ``named``: it names the format itself.
    """
    eligible = local & (kind == "event") & ~index_source & ~past
    mismatch, weak = negative & ~named, ~competes & ~named
    reason = F.when(mismatch, "title names a non-hackathon format").when(weak, "no competition or submission evidence")
    published = eligible & (confidence >= CONFIDENCE_BAR)
    label = F.when(published & ~mismatch & ~weak, "hackathon").when(published, "adjacent").when(eligible & (confidence >= NEAR_MISS_FLOOR), "near miss").otherwise("none")
    return F.struct(label.alias("label"), F.when(label == "adjacent", reason).alias("reason"))


def listing_local(regions: Regions, city: Column, state: Column, evidence: Column, index_is_local: Column) -> Column:
    """A listed event is local by its own place: never in an unserved state; by its city where it has one; else by its text or a local index."""
    place = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")))
    return F.when(regions.unserved(state), F.lit(False)).when(F.coalesce(city, F.lit("")) != "", place.rlike(regions.places)).otherwise(evidence.rlike(regions.places) | index_is_local)


def listing_label(confidence: Column, local: Column, past: Column, negative: Column, competes: Column, named: Column) -> Column:
    """(label, reason) of an event in a listing."""
    return publish_label(confidence, local, F.lit("event"), F.lit(False), past, negative, competes, named)


def source_window(start_ms: Column, now_ms: Column, online_only: Column, unserved: Column, city: Column, named: Column, recurring: Column, days: int = 180) -> Column:
    """Why a search page's event is skipped: outside the window, online, not local, not of the format; recurring ones are kept aside."""
    return first_true((start_ms.isNull() | (start_ms < now_ms) | (start_ms > now_ms + days * 86_400_000), "past"), (online_only, "online"), (unserved | city.isNull(), "not local"), (~named, "not hackathon"), (recurring, "recurring"))


def listed_source(place: Column, placed: Column, invite_only: Column, end_ms: Column, now_ms: Column) -> Column:
    """Why a listing source's row is skipped: elsewhere, unplaceable in the country, by invitation, undated, or over."""
    domestic = F.coalesce(place, F.lit("")).rlike(r"(?i)\b(usa|united states|,\s*ca\b|california)\b")
    return first_true((~placed & ~domestic, "not local"), (~placed, "unplaceable"), (invite_only, "invite only"), (end_ms.isNull(), "undated"), (end_ms < now_ms, "past"))


def virtual_source(rows: DataFrame, start_ms: str, end_ms: str, venue: str, identity: Sequence[str], ordinal: str, now_ms: Column) -> DataFrame:
    """``reason`` per row: undated, ended, irl, duplicate language (not the first of its identity among those left), or null."""
    reason = first_true((F.col(start_ms).isNull() | F.col(end_ms).isNull(), "undated"), (F.col(end_ms) <= now_ms, "ended"), (F.lower(F.coalesce(venue, F.lit(""))) != "virtual", "irl"))
    rows = rows.withColumn("reason", reason)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(f"_{c}") for c in identity]
    first = rows.filter("reason IS NULL").groupBy(*key).agg(F.min(ordinal).alias("_first"))
    same = [F.coalesce(F.col(c).cast("string"), F.lit("?")) == F.col(f"_{c}") for c in identity]
    joined = rows.join(first, same, "left")
    return joined.withColumn("reason", F.coalesce("reason", F.when(F.col(ordinal) != F.col("_first"), "duplicate language"))).select(*rows.columns)


def event_page_reject(structured: Column, state: Column, unserved: Column, city: Column, end_ms: Column, now_ms: Column, confidence: Column, allow_unplaced: bool = False) -> Column:
    """Why an event page makes no candidate, the first reason that holds; null when it does."""
    return F.coalesce(
        F.when(~structured, "no markup"),
        F.when(unserved, F.concat(F.lit("region "), state)),
        F.lit(None).cast("string") if allow_unplaced else F.when(city.isNull(), "no city"),
        F.when(F.coalesce(end_ms < now_ms, F.lit(False)), "ended"),
        F.when(confidence < CONFIDENCE_BAR, F.concat(F.lit("confidence "), confidence.cast("string"))),
    )


def calendar_items(items: DataFrame, claimed: DataFrame, series: Sequence[str], now_ms: Column) -> DataFrame:
    """Items of ``url, calendar, title, end_ms`` that are worth a page: unclaimed, not over, of a series calendar or named like the format."""
    named = F.col("calendar").isin(list(series)) | facts.names_terms("title") | F.col("title").rlike("(?i)hack")
    return items.filter(F.col("url").isNotNull() & F.col("title").isNotNull() & named & F.coalesce(F.col("end_ms") >= now_ms, F.lit(True))).join(claimed.select("url"), "url", "left_anti")


def calendar_seeds(records: DataFrame, now_ms: Column) -> DataFrame:
    """Distinct calendars of records that are not over and are named hack, or matched the format."""
    alive = F.coalesce(F.col("end_ms") >= now_ms, F.lit(True))
    return records.filter(F.col("calendar").isNotNull() & alive & (F.col("title").rlike("(?i)hack") | facts.names_format("title"))).select("calendar").distinct()


def retained(board: DataFrame, candidates: DataFrame, now_ms: Column, most: int = 80) -> DataFrame:
    """The first ``most`` upcoming feed records of the last board that this run has not found again."""
    upcoming = board.filter((F.col("platform") == "luma") & (F.col("end_ms") >= now_ms)).orderBy("ordinal").limit(most)
    return upcoming.join(candidates.select("url"), "url", "left_anti")


def fillable(time_unverified: Column, start_ms: Column, any_time: bool = False) -> Column:
    """A calendar entry can be made: its time is verified and known, or any time will do."""
    return F.lit(True) if any_time else ~F.coalesce(time_unverified, F.lit(False)) & start_ms.isNotNull()


def queue_split(platform: Column, time_unverified: Column, start_ms: Column, any_time: bool = False) -> Column:
    """automatic on the own platform, manual with a trusted time, else declined."""
    return F.when(platform == "luma", "automatic").when(fillable(time_unverified, start_ms, any_time), "manual").otherwise("declined")
