"""Queries over notices: what titles and evidence say, when and where, and what is published.

Notices are made of whole orders by one SQL text that Spark and DuckDB both read; every
order is one, and its remainders only pick which wording, place and offer it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import facts
from brightquay.operators import gates, publish
from brightquay.operators.gates import Region, Regions
from brightquay.plans.board import NOW_MS, table

ZONE = "America/Los_Angeles"
CATEGORIES = ("AI", "Tech", "Arts & Culture")
REGIONS = Regions(
    Region("bay", "Bay Area", ZONE, ("CA", "California"), {"SF": ("San Francisco", "SF"), "East Bay": ("Oakland", "Berkeley"), "Peninsula": ("Palo Alto",)}, "SF", {"SF": 8, "East Bay": 3}),
    Region("south", "San Diego", ZONE, ("CA", "California"), {"San Diego": ("San Diego",)}, "San Diego", {"San Diego": 6}),
    Region("online", "Online", "America/New_York", (), {}, None, {}, True),
)

NOTICES = """
SELECT o_orderkey AS id, o_custkey AS c,
  CASE o_orderkey % 9 WHEN 0 THEN 'Spring AI Hackathon ' WHEN 1 THEN 'Data Summit ' WHEN 2 THEN 'Robot-a-thon at Night ' WHEN 3 THEN 'Founders Happy Hour '
    WHEN 4 THEN 'Venue placeholder - hall ' WHEN 5 THEN 'Teams of developers compete ' WHEN 6 THEN 'Voice agent buildathons ' WHEN 7 THEN 'Weekly meet-up, demo day ' ELSE 'Hack the grid ' END || CAST(o_custkey AS STRING) AS title,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://luma.com/e' ELSE 'https://www.Events-' || CAST(o_custkey % 40 AS STRING) || '.example.org/x/' END || CAST(o_orderkey AS STRING) AS url,
  CASE o_orderkey % 4 WHEN 0 THEN 'Presented by' || chr(10) || 'Guild ' || CAST(o_custkey % 40 AS STRING) || chr(10) WHEN 1 THEN 'Hosted By' || chr(10) || 'Host ' || CAST(o_custkey % 30 AS STRING) || chr(10) ELSE '' END
  || CASE o_orderkey % 5 WHEN 0 THEN 'Build a prototype with your team' WHEN 1 THEN 'Judging by experts and mentors' WHEN 2 THEN 'submission deadline, open track' WHEN 3 THEN 'come by and ship' ELSE 'apply to attend' END || chr(10)
  || 'Doors open' || chr(10)
  || CASE o_orderkey % 7 WHEN 0 THEN 'Hall ' || CAST(o_custkey % 9 AS STRING) || chr(10) || 'San Francisco, CA' WHEN 1 THEN 'Loft, oakland' WHEN 2 THEN 'Register to See Address' || chr(10) || 'Palo Alto, California' WHEN 3 THEN 'Berlin, Germany' WHEN 4 THEN '12 Main, CA' WHEN 5 THEN 'Pier in San Diego' ELSE 'somewhere' END || chr(10)
  || 'Registration' || chr(10)
  || CASE o_orderkey % 8 WHEN 0 THEN 'Sold Out' WHEN 1 THEN 'Join Waitlist' WHEN 2 THEN 'Registration Closed' WHEN 3 THEN 'Register' WHEN 4 THEN 'Approval Required' WHEN 5 THEN 'Applications closed' ELSE 'See the page' END || chr(10) || 'About Event' || chr(10)
  || CASE o_orderkey % 6 WHEN 0 THEN 'Cash prize of $ 5,000' WHEN 1 THEN 'Prizes: $10k+ in credits' WHEN 2 THEN 'Prize pool: TBA' WHEN 3 THEN 'Bounties for all' WHEN 4 THEN 'nothing to win for $5' ELSE 'an evening of demos' END || chr(10)
  || CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey % 90 AS STRING) || ' Going' || chr(10) ELSE '' END
  || CASE o_orderkey % 4 WHEN 2 THEN 'Report Event' || chr(10) || 'AI' || chr(10) || 'Other' || chr(10) || 'Tech' WHEN 3 THEN 'Report Event' || chr(10) || 'Tech' || chr(10) || 'AI' ELSE 'data and design for infra' END AS evidence,
  CASE WHEN o_orderkey % 5 = 0 THEN 'adjacent' ELSE 'hackathon' END AS category, CASE WHEN o_orderkey % 10 = 0 THEN 'held' END AS held_because,
  CAST(20 + o_orderkey % 80 AS INT) AS confidence, 'via-' || o_orderpriority AS via, 'checked' AS checked_at,
  CASE WHEN o_orderkey % 37 > 0 THEN $MS + (o_orderkey % 24) * 3600000 END AS start_ms, CASE WHEN o_orderkey % 41 > 0 THEN $MS + (o_orderkey % 24) * 3600000 + (1 + o_custkey % 50) * 3000000 END AS end_ms,
  CASE o_orderkey % 7 WHEN 0 THEN 'San Francisco' WHEN 1 THEN 'oakland' WHEN 2 THEN 'Palo Alto' WHEN 3 THEN 'Berlin' WHEN 4 THEN '' WHEN 5 THEN 'San Diego' END AS city,
  CASE o_orderkey % 7 WHEN 0 THEN 'CA' WHEN 1 THEN 'california' WHEN 3 THEN 'Bavaria' WHEN 4 THEN 'NV' WHEN 6 THEN '' END AS state,
  CASE o_orderkey % 11 WHEN 0 THEN 'Online' WHEN 1 THEN 'Virtual event' WHEN 2 THEN NULL ELSE 'Hall ' || CAST(o_custkey % 9 AS STRING) END AS venue,
  CASE o_orderkey % 13 WHEN 0 THEN -420 WHEN 1 THEN -480 WHEN 2 THEN 480 WHEN 3 THEN -300 END AS offset_minutes,
  CASE o_orderkey % 9 WHEN 0 THEN 'SoldOut' WHEN 1 THEN 'InStock' WHEN 2 THEN 'https://schema.org/SoldOut' END AS availability,
  CASE WHEN o_orderkey % 31 = 0 THEN 'https://schema.org/EventCancelled' END AS event_status,
  CASE WHEN o_orderkey % 4 = 1 THEN 'Org ' || CAST(o_custkey % 20 AS STRING) END AS host_name, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 700 AS INT) END AS going
FROM $ORDERS
"""
N = f"n AS ({NOTICES.replace('$MS', 'epoch_ms(o_orderdate)').replace('$ORDERS', 'orders')})"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice per order."""
    ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))"
    n = spark.sql(NOTICES.replace("$MS", ms).replace("$ORDERS", "{orders}"), orders=table(spark, sf_dir, "orders"))
    return n.withColumn("online", REGIONS.is_online(F.col("venue"))).withColumn("organizers", F.array("host_name"))


def _terms(t: str) -> str:
    return rf"(regexp_matches({t}, '(?i)\b(game jam|code sprint|buildathon|hackathon|datathon)s?\b') OR regexp_matches({t}, '{facts.ATHON}') OR regexp_matches({t}, '{facts.BUILDERS_COMPETE}'))"


_PLACES = r"(?i)\b(san francisco|san diego|palo alto|berkeley|oakland|sf)\b"
_TITLED = lambda x: f"list_aggregate(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
_LINES = "list_filter(list_transform(string_split(evidence, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def notice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence flags, confidence and relevance under the three scorers, and the format's names."""
    n = notices(spark, sf_dir).select("id", "title", *[facts.signals("title", "evidence", REGIONS.places, v).alias(k) for k, v in (("general", facts.GENERAL), ("pages", facts.PAGES), ("titled", facts.TITLED))])
    parts = [F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in ("general", "pages", "titled") for f in ("build", "compete", "negative", "confidence", "relevance")]
    return n.select("id", facts.names_terms("title").alias("terms"), facts.names_format("title").alias("named"), F.col("general.direct").alias("direct"), F.col("general.local").alias("local"), *parts)


def _scorer(k: str, v: facts.Vocabulary) -> tuple[str, str]:
    flags = f"regexp_matches(b, '{v.build}') AS {k}_build, regexp_matches(b, '{v.compete}') AS {k}_compete, regexp_matches(title, '{v.negative}') AS {k}_negative, regexp_matches(b, '{v.register}') AS {k}_register"
    conf = f"greatest(0, least(100, CASE WHEN direct THEN 62 ELSE 20 END + {k}_build::INT * 16 + {k}_compete::INT * 16 - {k}_negative::INT * CASE WHEN {k}_build AND {k}_compete THEN 0 ELSE 30 END))"
    return flags, f"{k}_build, {k}_compete, {k}_negative, {conf} AS {k}_confidence, CAST(greatest(0, least(100, floor({conf} * 0.65::DOUBLE + 0.5) + local::INT * 20 + {k}_register::INT * 8 + reward::INT * 7)) AS INT) AS {k}_relevance"


_SCORERS = [_scorer(k, v) for k, v in (("general", facts.GENERAL), ("pages", facts.PAGES), ("titled", facts.TITLED))]
NOTICE_SCORES = rf"""
WITH {N}, b AS (SELECT *, title || chr(10) || evidence AS b FROM n),
f AS (SELECT id, {_terms('title')} AS terms, {_terms('title')} OR regexp_matches(title, '{facts.STANDALONE_HACK}') AS named, {_terms('b')} OR regexp_matches(title, '{facts.STANDALONE_HACK}') AS direct,
  regexp_matches(b, '{_PLACES}') AS local, regexp_matches(b, '{facts.REWARDS}') AS reward, {', '.join(f for f, _ in _SCORERS)} FROM b)
SELECT id, terms, named, direct, local, {', '.join(s for _, s in _SCORERS)} FROM f
"""


def notice_prizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount and label of the prize, and a marked-up prize cleaned."""
    markup = F.concat(F.lit("<b>$</b><span>"), F.when(F.col("id") % 3 == 0, "0").otherwise(F.col("c").cast("string")), F.lit("</span>&nbsp;"))
    return notices(spark, sf_dir).withColumn("p", facts.prize("title", "evidence")).select("id", F.col("p.amount").alias("amount"), F.col("p.label").alias("label"), facts.clean_prize(markup).alias("cleaned"))


NOTICE_PRIZES = rf"""
WITH {N}, p AS (SELECT *, title || chr(10) || evidence AS b FROM n),
l AS (SELECT *, list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '(?i)priz|cash|bount|credits') AND regexp_matches(x, '{facts.MONEY}'))[1] AS line FROM p),
a AS (SELECT *, replace(regexp_extract(line, '{facts.MONEY}'), ' ', '') AS amount FROM l)
SELECT id, amount, CASE WHEN line IS NOT NULL THEN amount || CASE WHEN regexp_matches(line, '(?i)cash') THEN ' cash' ELSE ' prizes' END WHEN regexp_matches(b, '{facts.PRIZES_TO_COME}') THEN 'Prizes TBA'
  WHEN regexp_matches(b, '(?i)priz|bount') THEN 'Prizes listed' ELSE 'Not listed' END AS label, CASE WHEN id % 3 <> 0 AND c <> 0 THEN '$' || c END AS cleaned FROM a
"""


def notice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration by the page's block alone, by all witnesses, and by a feed's fields."""
    n = notices(spark, sf_dir).withColumn("lines", facts.lines_of("evidence"))
    feed = facts.feed_status(F.col("id") % 7 == 0, F.element_at(F.array(*map(F.lit, ("open", "waitlist", "closed", "sold_out", "other"))), (F.col("c") % 5 + 1).cast("int")))
    return n.select("id", facts.page_status(F.col("lines")).alias("page"), facts.status("evidence", F.col("lines"), F.col("availability"), F.col("event_status")).alias("status"), feed.alias("feed"))


NOTICE_STATUS = rf"""
WITH {N}, l AS (SELECT *, {_LINES} AS l FROM n), k AS (SELECT *, list_position(l, 'Registration') AS a, list_position(l, 'About Event') AS z FROM l),
b AS (SELECT *, array_to_string(list_slice(l, a + 1, z - 1), chr(10)) AS block FROM k),
p AS (SELECT *, CASE WHEN regexp_matches(block, '(?i)Sold Out') THEN 'Sold out' WHEN regexp_matches(block, '(?i)Join Waitlist|Event Full') THEN 'Waitlist' WHEN regexp_matches(block, '(?i)Registration Closed|not currently taking registrations') THEN 'Closed'
  WHEN regexp_matches(block, '(?m)^Register$') THEN 'Open' WHEN regexp_matches(block, '(?i)Approval Required|Request to Join|Require Approval') THEN 'Approval' ELSE 'Check page' END AS page FROM b)
SELECT id, page, CASE WHEN contains(coalesce(event_status, ''), 'EventCancelled') THEN 'Cancelled' WHEN regexp_matches(evidence, '(?i)applications? closed|application deadline.*(?:passed|closed)') THEN 'Closed'
  WHEN availability IN ('SoldOut', 'https://schema.org/SoldOut') THEN 'Sold out' WHEN availability = 'InStock' THEN 'Open' WHEN page <> 'Check page' THEN page
  WHEN regexp_matches(evidence, '(?i)applications? open|apply to attend') THEN 'Approval' WHEN regexp_matches(evidence, '(?i)register|registration open') THEN 'Open' ELSE page END AS status,
  CASE WHEN id % 7 = 0 OR c % 5 = 1 THEN 'Waitlist' WHEN c % 5 = 0 THEN 'Open' WHEN c % 5 IN (2, 3) THEN 'Closed' END AS feed FROM p
"""


def notice_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizers by the ladder and in prose, tags, and the tags a calendar wants."""
    n = notices(spark, sf_dir).withColumn("lines", facts.lines_of("evidence"))
    prose = F.concat(F.lit("Tonight "), F.when(F.col("id") % 3 == 0, "Acme Labs is hosting").when(F.col("id") % 3 == 1, "hosted by Beta Co at noon").otherwise("at noon"))
    region = REGIONS.region_of(F.col("city"), F.col("online"))
    wanted = facts.desired_tags(F.col("category"), REGIONS.area_of(F.col("city"), region), REGIONS.core(region), REGIONS.label(region))
    return n.select(
        "id",
        publish.organizer(F.col("organizers"), F.col("lines"), F.col("url")).alias("organizer"),
        facts.prose_organizer(prose, "Nobody").alias("prose"),
        F.array_join(facts.notice_tags(F.col("lines"), F.col("title"), F.col("evidence"), CATEGORIES), "|").alias("tags"),
        F.array_join(wanted, "|").alias("wanted"),
    )


_KEYWORDS = ", ".join(f"CASE WHEN regexp_matches(b, '{p}') THEN '{t}' END" for t, p in facts.KEYWORD_TAGS.items())
NOTICE_HOSTS = rf"""
WITH {N}, l AS (SELECT *, {_LINES} AS l, title || chr(10) || substr(evidence, 1, 500) AS b FROM n),
k AS (SELECT *, list_position(l, 'Presented by') AS p, list_position(l, 'Hosted By') AS h, list_filter([{_KEYWORDS}], lambda x: x IS NOT NULL) AS words,
  CASE WHEN contains(evidence, 'Report Event') THEN CASE id % 4 WHEN 2 THEN ['AI'] ELSE ['Tech', 'AI'] END ELSE CAST([] AS VARCHAR[]) END AS named,
  CASE WHEN venue IN ('Online', 'Virtual event') THEN 3 WHEN lower(city) = 'san diego' THEN 2 ELSE 1 END AS r FROM l)
SELECT id, coalesce(host_name, CASE WHEN p > 0 THEN l[p + 1] WHEN h > 0 THEN l[h + 1] ELSE lower(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\.', '')) END) AS organizer,
  CASE id % 3 WHEN 0 THEN 'Tonight Acme Labs' WHEN 1 THEN 'Beta Co' ELSE 'Nobody' END AS prose,
  array_to_string(list_concat(named, list_filter(words, lambda w: NOT list_contains(named, w)))[1:4], '|') AS tags,
  CASE WHEN category = 'adjacent' THEN 'Tech Events' ELSE 'Hackathon' END || '|' || CASE WHEN r = 3 THEN 'Online' WHEN r = 2 THEN 'San Diego' WHEN lower(city) = 'san francisco' THEN 'SF' ELSE 'Bay Area' END AS wanted FROM k
"""


def notice_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue and city of the lines behind the time line, and what else place strings say."""
    n = notices(spark, sf_dir).withColumn("lines", facts.lines_of("evidence"))
    n = n.withColumn("p", facts.page_place(F.col("lines"), (F.array_position("lines", F.lit("Doors open")) - 1).cast("int"), REGIONS.places))
    stated_place = F.concat_ws(", ", "venue", "city", "state")
    return n.select("id", "p.venue", "p.city", facts.venue_residue(F.concat_ws(", ", "city", "state", F.lit("United States")), F.col("city")).alias("residue"), facts.worth_placing(stated_place).alias("worth"), REGIONS.resolve_city(stated_place).alias("resolved"))


NOTICE_PLACES = rf"""
WITH {N}, s AS (SELECT *, array_to_string(list_filter([venue, city, state], lambda x: x IS NOT NULL), ', ') AS place FROM n)
SELECT id, CASE id % 7 WHEN 0 THEN 'Hall ' || (c % 9) WHEN 1 THEN 'Loft' WHEN 4 THEN '12 Main, CA' WHEN 5 THEN 'Pier in' WHEN 6 THEN 'somewhere' WHEN 3 THEN 'Berlin, Germany' END AS venue,
  CASE id % 7 WHEN 0 THEN 'San Francisco' WHEN 1 THEN 'Oakland' WHEN 2 THEN 'Palo Alto' WHEN 5 THEN 'San Diego' END AS city,
  CASE id % 7 WHEN 3 THEN 'Berlin, Bavaria, United States' WHEN 4 THEN ', NV, United States' END AS residue,
  trim(place) <> '' AND (NOT contains(place, ',') OR regexp_matches(place, '(?i)\b(usa|united states|,\s*ca\b|california)\b')) AS worth,
  CASE id % 7 WHEN 0 THEN 'San Francisco' WHEN 1 THEN 'oakland' WHEN 2 THEN 'Palo Alto' WHEN 5 THEN 'San Diego' END AS resolved FROM s
"""


def notice_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builder value, accessibility, labels of the schedule and the sentence about it."""
    n = notices(spark, sf_dir).withColumn("p", facts.prize("title", "evidence")).withColumn("s", facts.status("evidence", facts.lines_of("evidence"), F.col("availability"), F.col("event_status")))
    region = REGIONS.region_of(F.col("city"), F.col("online"))
    n = n.withColumn("said", facts.described(F.col("start_ms"), F.col("end_ms")))
    return n.select(
        "id",
        facts.builder_value(F.col("start_ms"), F.col("end_ms"), F.col("p.amount"), F.col("p.label"), "evidence").alias("builder"),
        facts.accessibility(F.col("s"), REGIONS.bonus(region, REGIONS.area_of(F.col("city"), region))).alias("access"),
        F.col("said.label").alias("label"),
        F.col("said.detail").alias("detail"),
        facts.why(F.col("start_ms"), F.col("end_ms"), F.col("p.label"), "evidence").alias("why"),
    )


_CLOCK = lambda t: f"strftime({t}, '%-I') || CASE WHEN minute({t}) > 0 THEN strftime({t}, ':%M') ELSE '' END || CASE WHEN hour({t}) >= 12 THEN 'pm' ELSE 'am' END"
NOTICE_VALUES = rf"""
WITH {N}, p AS ({NOTICE_PRIZES.replace('WITH ' + N + ', p AS', 'WITH q AS').replace('FROM p)', 'FROM q)')}), s AS ({NOTICE_STATUS.replace('WITH ' + N + ', l AS', 'WITH l AS')}),
j AS (SELECT n.*, amount, label, status, (end_ms - start_ms) / 3.6e6::DOUBLE AS hours, make_timestamp(start_ms * 1000) AS a, make_timestamp(end_ms * 1000) AS b FROM n JOIN p USING (id) JOIN s USING (id)),
v AS (SELECT *, date_diff('day', a::DATE, b::DATE) AS days, array_to_string(list_filter([CASE WHEN regexp_matches(evidence, '(?i)judg') THEN 'judging' END, CASE WHEN regexp_matches(evidence, '(?i)\bdemo') THEN 'demos' END,
  CASE WHEN regexp_matches(evidence, '(?i)\bteam') THEN 'team formation' END, CASE WHEN regexp_matches(evidence, '(?i)submission|deadline') THEN 'a submission deadline' END], lambda x: x IS NOT NULL), ', ') AS formats FROM j)
SELECT id, least(100, 55 + CASE WHEN coalesce(amount, '') <> '' THEN 15 WHEN label = 'Prizes listed' THEN 8 ELSE 0 END + CASE WHEN hours >= 8 THEN 10 ELSE 0 END + regexp_matches(evidence, '(?i)judg')::INT * 8 + regexp_matches(evidence, '(?i)mentor|expert|partner engineer')::INT * 6 + regexp_matches(evidence, '(?i)\btrack')::INT * 5) AS builder,
  greatest(0, least(100, CASE status WHEN 'Open' THEN 92 WHEN 'Approval' THEN 74 WHEN 'Waitlist' THEN 45 WHEN 'Closed' THEN 28 WHEN 'Sold out' THEN 35 ELSE 60 END
    + CASE WHEN venue IN ('Online', 'Virtual event') THEN -5 WHEN lower(city) = 'san francisco' THEN 8 WHEN lower(city) = 'oakland' THEN 3 WHEN lower(city) = 'san diego' THEN 6 ELSE -5 END)) AS access,
  CASE WHEN a IS NULL OR b IS NULL THEN 'TBC' ELSE upper(strftime(a, '%b %d')) END AS label,
  CASE WHEN a IS NULL OR b IS NULL THEN 'Date on event page' WHEN days = 0 THEN strftime(a, '%a') || ' · ' || {_CLOCK('a')} || '–' || {_CLOCK('b')} ELSE strftime(a, '%a') || '–' || strftime(b, '%a') || ' · ' || (days + 1) || ' days' END AS detail,
  CASE WHEN hours IS NULL THEN 'Build event' WHEN hours > 24 THEN CAST(ceil(hours / 24) AS BIGINT) || '-day build' ELSE CAST(floor(hours + 0.5) AS BIGINT) || '-hour build' END
    || CASE WHEN formats <> '' THEN ' with ' || formats ELSE '' END || CASE WHEN label <> 'Not listed' THEN '; ' || lower(label) || '.' ELSE '.' END AS why FROM v
"""


def notice_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why schedules and places keep notices from the board, and what can go on a calendar."""
    n, c = notices(spark, sf_dir), F.col
    return n.select(
        "id",
        gates.schedule_drop(c("start_ms"), c("end_ms"), F.lit(NOW_MS - 86_400_000), F.lit(NOW_MS)).alias("schedule"),
        gates.region_drop(REGIONS, c("city"), c("state"), c("venue"), c("start_ms"), c("offset_minutes")).alias("place"),
        gates.queue_split(F.when(c("id") % 3 == 0, "luma").otherwise("external"), c("id") % 5 == 0, c("start_ms")).alias("queue"),
        gates.fillable(c("id") % 5 == 0, c("start_ms")).alias("fillable"),
    )


_OFFSET = lambda z: f"date_diff('minute', make_timestamp(start_ms * 1000), timezone('{z}', make_timestamptz(start_ms * 1000)))"
NOTICE_DROPS = rf"""
WITH {N}, k AS (SELECT *, venue IN ('Online', 'Virtual event') AS online, lower(coalesce(city, '')) IN ('san francisco', 'oakland', 'palo alto', 'san diego') AS served FROM n)
SELECT id, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'no schedule' WHEN end_ms < {NOW_MS} THEN 'over' END AS schedule,
  CASE WHEN coalesce(city, '') <> '' AND NOT served AND NOT coalesce(online, false) THEN 'city' WHEN coalesce(state, '') <> '' AND lower(state) NOT IN ('ca', 'california') THEN 'state'
    WHEN NOT served AND NOT coalesce(online, false) AND offset_minutes IS NOT NULL AND start_ms IS NOT NULL AND offset_minutes NOT IN ({_OFFSET('America/Los_Angeles')}, {_OFFSET('America/New_York')}) THEN 'offset' END AS place,
  CASE WHEN id % 3 = 0 THEN 'luma' ELSE 'x' END = 'luma' AS _l, id % 5 <> 0 AND start_ms IS NOT NULL AS fillable FROM k
"""
NOTICE_DROPS = f"SELECT id, schedule, place, CASE WHEN _l THEN 'automatic' WHEN fillable THEN 'manual' ELSE 'declined' END AS queue, fillable FROM ({NOTICE_DROPS})"


def notice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish gates of pages and of listed events, and why event pages make no candidate."""
    n, c = notices(spark, sf_dir), F.col
    n = n.withColumn("s", facts.signals("title", "evidence", REGIONS.places, facts.PAGES)).withColumn("path", F.when(c("id") % 17 == 0, "/discover/x").when(c("id") % 19 == 0, "/user/x").otherwise("/e"))
    kind, past = facts.page_kind(c("title"), c("path")), facts.is_past(c("evidence"), c("end_ms"), F.lit(NOW_MS))
    negative, named = c("title").rlike(facts.FORMATS), facts.names_format("title")
    page = gates.publish_label(c("s.confidence"), facts.local_header(c("evidence"), REGIONS.places), kind, c("id") % 23 == 0, past, negative, c("s.compete"), named)
    local = gates.listing_local(REGIONS, c("city"), c("state"), c("evidence"), c("id") % 2 == 0)
    listed = gates.listing_label(c("s.confidence"), local, past, negative, c("s.compete"), named)
    reject = gates.event_page_reject(c("id") % 29 > 0, c("state"), REGIONS.unserved(c("state")), REGIONS.resolve_city(c("city")), c("end_ms"), F.lit(NOW_MS), c("s.confidence"))
    return n.select("id", kind.alias("kind"), past.alias("past"), page["label"].alias("page"), page["reason"].alias("page_reason"), listed["label"].alias("listed"), listed["reason"].alias("listed_reason"), reject.alias("reject"))


_LABEL = lambda eligible: f"CASE WHEN {eligible} AND conf >= 54 AND NOT mismatch AND NOT weak THEN 'hackathon' WHEN {eligible} AND conf >= 54 THEN 'adjacent' WHEN {eligible} AND conf >= 45 THEN 'near miss' ELSE 'none' END"
_REASON = lambda label: f"CASE WHEN {label} = 'adjacent' THEN CASE WHEN mismatch THEN 'title names a non-hackathon format' ELSE 'no competition or submission evidence' END END"
NOTICE_LABELS = rf"""
WITH {N}, b AS (SELECT *, title || chr(10) || evidence AS b FROM n),
f AS (SELECT *, {_terms('title')} OR regexp_matches(title, '{facts.STANDALONE_HACK}') AS named, {_terms('b')} OR regexp_matches(title, '{facts.STANDALONE_HACK}') AS direct, {_SCORERS[1][0]}, regexp_matches(substr(evidence, 1, 700), '{_PLACES}') AS header,
  CASE WHEN id % 17 = 0 THEN 'collection' WHEN id % 19 = 0 THEN 'profile' ELSE 'event' END AS kind, coalesce(end_ms < {NOW_MS}, false) AS past, coalesce(state, '') <> '' AND lower(state) NOT IN ('ca', 'california') AS unserved FROM b),
g AS (SELECT *, greatest(0, least(100, CASE WHEN direct THEN 62 ELSE 20 END + pages_build::INT * 16 + pages_compete::INT * 16 - pages_negative::INT * CASE WHEN pages_build AND pages_compete THEN 0 ELSE 30 END)) AS conf,
  regexp_matches(title, '{facts.FORMATS}') AND NOT named AS mismatch, NOT pages_compete AND NOT named AS weak,
  CASE WHEN unserved THEN false WHEN coalesce(city, '') <> '' THEN regexp_matches(city || ', ' || coalesce(state, ''), '{_PLACES}') ELSE regexp_matches(evidence, '{_PLACES}') OR id % 2 = 0 END AS local FROM f),
h AS (SELECT *, {_LABEL("(header AND kind = 'event' AND id % 23 <> 0 AND NOT past)")} AS page, {_LABEL('(local AND NOT past)')} AS listed FROM g)
SELECT id, kind, past, page, {_REASON('page')} AS page_reason, listed, {_REASON('listed')} AS listed_reason,
  CASE WHEN id % 29 = 0 THEN 'no markup' WHEN unserved THEN 'region ' || state WHEN lower(coalesce(city, '')) NOT IN ('san francisco', 'oakland', 'palo alto', 'san diego') THEN 'no city' WHEN past THEN 'ended' WHEN conf < 54 THEN 'confidence ' || conf END AS reject FROM h
"""


def notice_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of why three kinds of sources skip rows."""
    n, c = notices(spark, sf_dir), F.col
    window = gates.source_window(c("start_ms"), F.lit(NOW_MS - 400 * 86_400_000), c("online"), REGIONS.unserved(c("state")), REGIONS.resolve_city(c("city")), facts.names_format("title"), c("title").rlike(r"(?i)\bweekly\b"), 800)
    listed = gates.listed_source(c("state"), c("online") | REGIONS.resolve_city(c("city")).isNotNull(), c("id") % 7 == 2, c("end_ms"), F.lit(NOW_MS))
    rows = n.select("id", "start_ms", "end_ms", F.when(c("id") % 4 > 0, "Virtual").alias("form"), (c("c") % 50).alias("owner"), F.when(c("id") % 2 > 0, c("c") % 3).alias("pool"))
    virtual = gates.virtual_source(rows, "start_ms", "end_ms", "form", ("owner", "pool"), "id", F.lit(NOW_MS))
    of = lambda df, source: df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit(source).alias("source"), "reason", "n", "first")
    return of(n.select("id", window.alias("reason")), "window").unionByName(of(n.select("id", listed.alias("reason")), "listed")).unionByName(of(virtual, "virtual"))


NOTICE_SKIPS = rf"""
WITH {N}, k AS (SELECT *, coalesce(venue IN ('Online', 'Virtual event'), false) AS online, lower(coalesce(city, '')) IN ('san francisco', 'oakland', 'palo alto', 'san diego') AS placed, coalesce(state, '') <> '' AND lower(state) NOT IN ('ca', 'california') AS unserved,
  {_terms('title')} OR regexp_matches(title, '{facts.STANDALONE_HACK}') AS named FROM n),
w AS (SELECT id, CASE WHEN start_ms IS NULL OR start_ms < {NOW_MS - 400 * 86_400_000} OR start_ms > {NOW_MS + 400 * 86_400_000} THEN 'past' WHEN online THEN 'online' WHEN unserved OR NOT placed THEN 'not local' WHEN NOT named THEN 'not hackathon' WHEN regexp_matches(title, '(?i)\bweekly\b') THEN 'recurring' END AS reason FROM k),
l AS (SELECT id, CASE WHEN NOT (online OR placed) AND NOT regexp_matches(coalesce(state, ''), '(?i)california') THEN 'not local' WHEN NOT (online OR placed) THEN 'unplaceable' WHEN id % 7 = 2 THEN 'invite only' WHEN end_ms IS NULL THEN 'undated' WHEN end_ms < {NOW_MS} THEN 'past' END AS reason FROM k),
v AS (SELECT *, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'undated' WHEN end_ms <= {NOW_MS} THEN 'ended' WHEN id % 4 = 0 THEN 'irl' END AS r, c % 50 AS o, CASE WHEN id % 2 > 0 THEN c % 3 END AS p FROM n),
x AS (SELECT id, coalesce(r, CASE WHEN id <> min(CASE WHEN r IS NULL THEN id END) OVER (PARTITION BY o, p) THEN 'duplicate language' END) AS reason FROM v)
SELECT 'window' AS source, coalesce(reason, 'kept') AS reason, count(*) AS n, min(id) AS first FROM w GROUP BY 2 UNION ALL SELECT 'listed', coalesce(reason, 'kept'), count(*), min(id) FROM l GROUP BY 2 UNION ALL SELECT 'virtual', coalesce(reason, 'kept'), count(*), min(id) FROM x GROUP BY 2
"""


def calendar_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a calendar pass reads: items worth a page, seeds, and records to check again (a top-80 rule)."""
    n, c = notices(spark, sf_dir), F.col
    items = n.select("url", F.concat(F.lit("cal"), (c("c") % 60).cast("string")).alias("calendar"), "title", "end_ms")
    found = gates.calendar_items(items, n.filter(c("category") == "adjacent"), ["cal1", "cal2"], F.lit(NOW_MS)).select(F.lit("item").alias("kind"), c("url").alias("name"))
    seeds = gates.calendar_seeds(items, F.lit(NOW_MS)).select(F.lit("seed").alias("kind"), c("calendar").alias("name"))
    board = n.select("url", F.when(c("id") % 3 == 0, "luma").otherwise("external").alias("platform"), "end_ms", c("id").alias("ordinal"))
    again = gates.retained(board, n.filter(c("category") == "adjacent"), F.lit(NOW_MS)).select(F.lit("again").alias("kind"), c("url").alias("name"))
    return found.unionByName(seeds).unionByName(again)


CALENDAR_PASS = rf"""
WITH {N}, i AS (SELECT *, 'cal' || (c % 60) AS calendar, coalesce(end_ms >= {NOW_MS}, true) AS alive, {_terms('title')} AS terms, contains(lower(title), 'hack') AS hack FROM n)
SELECT 'item' AS kind, url AS name FROM i WHERE alive AND category <> 'adjacent' AND (calendar IN ('cal1', 'cal2') OR terms OR hack)
UNION ALL SELECT DISTINCT 'seed', calendar FROM i WHERE alive AND (hack OR terms)
UNION ALL SELECT 'again', url FROM (SELECT * FROM n WHERE id % 3 = 0 AND end_ms >= {NOW_MS} ORDER BY id LIMIT 80) WHERE category <> 'adjacent'
"""


def board_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each view of the board, and of a search in it."""
    n, c = notices(spark, sf_dir), F.col
    region = REGIONS.region_of(c("city"), c("online"))
    n = n.withColumn("prize", facts.prize("title", "evidence")["label"]).withColumn("status", facts.page_status(facts.lines_of("evidence"))).withColumn("area", REGIONS.area_of(c("city"), region)).withColumn("core", REGIONS.core(region))
    shown = n.withColumn("view", F.explode(F.array(*map(F.lit, ("hackathons", "open", "prizes", "city", "everything"))))).filter(gates.in_view(c("view"), c("category"), c("status"), c("prize"), c("area"), c("core"), c("title")))
    hit = gates.found_by(F.lit(" AGENT "), c("title"), c("host_name"), F.array("via"), c("city"))
    return shown.groupBy("view").agg(F.count("*").alias("n"), F.count_if(hit).alias("found"))


BOARD_VIEWS = rf"""
WITH {N}, p AS ({NOTICE_PRIZES.replace('WITH ' + N + ', p AS', 'WITH q AS').replace('FROM p)', 'FROM q)')}), s AS ({NOTICE_STATUS.replace('WITH ' + N + ', l AS', 'WITH l AS')}),
j AS (SELECT n.*, label, page FROM n JOIN p USING (id) JOIN s USING (id)), v AS (SELECT j.*, view FROM j, (VALUES ('hackathons'), ('open'), ('prizes'), ('city'), ('everything')) t(view))
SELECT view, count(*) AS n, count(*) FILTER (WHERE contains(lower(title), 'agent')) AS found FROM v
WHERE CASE view WHEN 'hackathons' THEN category = 'hackathon' AND NOT starts_with(lower(title), 'venue placeholder -') WHEN 'open' THEN page IN ('Open', 'Approval') WHEN 'prizes' THEN contains(label, '$')
  WHEN 'city' THEN NOT coalesce(venue IN ('Online', 'Virtual event'), false) AND lower(coalesce(city, '')) IN ('san francisco', 'san diego') ELSE true END GROUP BY view
"""


def published_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published records of scheduled notices in publishing order."""
    n, c = notices(spark, sf_dir), F.col
    n = n.filter(c("start_ms").isNotNull() & c("end_ms").isNotNull())
    board = publish.published(n, REGIONS, F.lit(NOW_MS), ZONE, CATEGORIES).withColumn("ordinal", F.regexp_extract("url", r"(\d+)$", 1).cast("long"))
    keys = publish.publish_order(c("category"), c("score"), c("start"), c("ordinal"))
    top = board.orderBy(*keys).limit(500)  # the board's first 500: a top-k report
    return top.select("url", "platform", "category", "organizer", "area", "region", "region_label", "start", "end", "date_label", "time_unverified", "status", "prize", F.array_join("tags", "|").alias("tags"), "going", "why", "score", "discovered_via")


PUBLISHED_BOARD = rf"""
WITH {N}, v AS ({NOTICE_VALUES.replace('WITH ' + N + ', p AS', 'WITH p AS')}), h AS ({NOTICE_HOSTS.replace('WITH ' + N + ', l AS', 'WITH l AS')}), s2 AS ({NOTICE_STATUS.replace('WITH ' + N + ', l AS', 'WITH l AS')}), p2 AS ({NOTICE_PRIZES.replace('WITH ' + N + ', p AS', 'WITH q AS').replace('FROM p)', 'FROM q)')}),
j AS (SELECT n.*, builder, access, why, organizer, tags, s2.status, p2.label AS prize, coalesce(venue IN ('Online', 'Virtual event'), false) AS online,
  (start_ms - {NOW_MS}) / 86400000 AS d, timezone('{ZONE}', make_timestamptz(start_ms * 1000)) AS a, timezone('{ZONE}', make_timestamptz(end_ms * 1000)) AS b FROM n JOIN v USING (id) JOIN h USING (id) JOIN s2 USING (id) JOIN p2 USING (id) WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
k AS (SELECT *, CASE WHEN d < 0 THEN 96 WHEN d <= 2 THEN 100 WHEN d <= 7 THEN 92 WHEN d <= 14 THEN 84 WHEN d <= 30 THEN 70 WHEN d <= 60 THEN 55 ELSE 40 END AS fresh, date_diff('minute', make_timestamp(start_ms * 1000), a) AS oa, date_diff('minute', make_timestamp(end_ms * 1000), b) AS ob,
  CASE WHEN online THEN 'Online' ELSE CASE lower(coalesce(city, '')) WHEN 'san francisco' THEN 'SF' WHEN 'oakland' THEN 'East Bay' WHEN 'palo alto' THEN 'Peninsula' WHEN 'san diego' THEN 'San Diego' ELSE 'Bay Area' END END AS area0 FROM j)
SELECT url, CASE WHEN id % 3 = 0 THEN 'luma' ELSE 'external' END AS platform, category, organizer, CASE lower(coalesce(city, '')) WHEN 'san francisco' THEN 'SF' WHEN 'oakland' THEN 'East Bay' WHEN 'palo alto' THEN 'Peninsula' WHEN 'san diego' THEN 'San Diego' ELSE area0 END AS area,
  CASE WHEN online THEN 'online' WHEN lower(city) = 'san diego' THEN 'south' ELSE 'bay' END AS region, CASE WHEN online THEN 'Online' WHEN lower(city) = 'san diego' THEN 'San Diego' ELSE 'Bay Area' END AS region_label,
  strftime(a, '%Y-%m-%dT%H:%M:00') || '-0' || (-oa // 60) || ':00' AS start, strftime(b, '%Y-%m-%dT%H:%M:00') || '-0' || (-ob // 60) || ':00' AS "end", upper(strftime(a, '%b %d')) AS date_label,
  hour(a) < 6 OR (end_ms - start_ms) / 3.6e6::DOUBLE < 1.5 AS time_unverified, status, prize, tags, coalesce(going, CASE WHEN id % 3 = 0 THEN CAST(c % 90 AS INT) END) AS going, why,
  CAST(floor(0.4::DOUBLE * confidence + 0.25::DOUBLE * builder + 0.2::DOUBLE * access + 0.15::DOUBLE * fresh + 0.5::DOUBLE) AS INT) AS score, via AS discovered_via FROM k
ORDER BY CASE WHEN category = 'hackathon' THEN 0 ELSE 1 END, score DESC, start, id LIMIT 500
"""


def board_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a board in one row."""
    n, c = notices(spark, sf_dir), F.col
    board = n.select("category", publish.organizer(c("organizers"), facts.lines_of("evidence"), c("url")).alias("organizer"), c("via").alias("discovered_via"), F.when(c("id") % 3 == 0, "luma").otherwise("external").alias("platform"), "id")
    return publish.board_meta(board, c("id") % 50 == 0, c("id") % 70 == 0)


BOARD_META = f"""
WITH {N}, h AS ({NOTICE_HOSTS.replace('WITH ' + N + ', l AS', 'WITH l AS')})
SELECT count(*) AS published, count(*) FILTER (WHERE category = 'hackathon') AS hackathons, count(*) FILTER (WHERE category = 'adjacent') AS adjacent, count(DISTINCT organizer) AS organizers, count(DISTINCT via) AS sources,
  count(*) FILTER (WHERE id % 3 <> 0) AS "external", count(*) FILTER (WHERE id % 50 = 0) AS deleted, count(*) FILTER (WHERE id % 70 = 0) AS redacted FROM n JOIN h USING (id)
"""


def resolver_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local day, host and area by which notices are compared."""
    return publish.resolvers(notices(spark, sf_dir), REGIONS, ZONE).select("id", "day", "host", "area")


RESOLVER_KEYS = rf"""
WITH {N}, h AS ({NOTICE_HOSTS.replace('WITH ' + N + ', l AS', 'WITH l AS')}), p AS (SELECT *, lower(coalesce(nullif(city, ''), nullif(regexp_extract(evidence, '{_PLACES}'), ''))) AS place FROM n)
SELECT id, strftime(timezone('{ZONE}', make_timestamptz(start_ms * 1000)), '%Y-%m-%d') AS day, lower(regexp_replace(organizer, '[^A-Za-z0-9]', '', 'g')) AS host,
  CASE WHEN place IS NULL THEN '' ELSE CASE place WHEN 'san francisco' THEN 'SF' WHEN 'oakland' THEN 'East Bay' WHEN 'palo alto' THEN 'Peninsula' WHEN 'san diego' THEN 'San Diego' ELSE 'Bay Area' END END AS area FROM p JOIN h USING (id)
"""


def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order merged with its customer's first one, as if they were one event."""
    n = notices(spark, sf_dir)
    rec = F.struct("url", "confidence", "start_ms", "end_ms", F.when(F.col("id") % 2 == 0, "feed").alias("time_source"), F.when(F.col("id") % 3 > 0, F.col("venue")).alias("venue"), "evidence")
    first = n.groupBy("c").agg(F.min_by(rec, "id").alias("a"))
    m = n.select("id", "c", rec.alias("b")).join(first, "c").withColumn("m", publish.merged_duplicate(F.col("a"), F.col("b"), ZONE))
    return m.select("id", "m.url", "m.confidence", "m.start_ms", "m.end_ms", "m.time_source", "m.venue", F.length("m.evidence").cast("long").alias("chars"))


MERGED_PAIRS = rf"""
WITH {N}, r AS (SELECT id, c, {{'url': url, 'confidence': confidence, 's': start_ms, 'e': end_ms, 't': CASE WHEN id % 2 = 0 THEN 'feed' END, 'v': CASE WHEN id % 3 > 0 THEN venue END, 'x': evidence}} AS r FROM n),
j AS (SELECT b.id, a.a, b.r AS b FROM r b JOIN (SELECT c, arg_min(r, id) AS a FROM r GROUP BY c) a USING (c)),
k AS (SELECT *, starts_with(a.url, 'https://luma.com/') AS la, starts_with(b.url, 'https://luma.com/') AS lb FROM j),
o AS (SELECT id, CASE WHEN (lb AND NOT la) OR (la = lb AND b.confidence > a.confidence) THEN b ELSE a END AS x, CASE WHEN (lb AND NOT la) OR (la = lb AND b.confidence > a.confidence) THEN a ELSE b END AS y FROM k),
q AS (SELECT *, x.s IS NOT NULL AND NOT coalesce(hour(timezone('{ZONE}', make_timestamptz(x.s * 1000))) < 6 OR (x.e - x.s) / 3.6e6::DOUBLE < 1.5, false) AS cx, y.s IS NOT NULL AND NOT coalesce(hour(timezone('{ZONE}', make_timestamptz(y.s * 1000))) < 6 OR (y.e - y.s) / 3.6e6::DOUBLE < 1.5, false) AS cy FROM o)
SELECT id, x.url AS url, x.confidence AS confidence, CASE WHEN NOT cx AND cy THEN y.s ELSE x.s END AS start_ms, CASE WHEN NOT cx AND cy THEN y.e ELSE x.e END AS end_ms, CASE WHEN NOT cx AND cy THEN coalesce(y.t, 'other') || '-via-duplicate' ELSE x.t END AS time_source,
  coalesce(x.v, y.v) AS venue, length(x.x) + CASE WHEN length(y.x) > length(x.x) THEN 1 + length(y.x) ELSE 0 END AS chars FROM q
"""

QUERIES = {
    "notice_scores": (notice_scores, NOTICE_SCORES),
    "notice_prizes": (notice_prizes, NOTICE_PRIZES),
    "notice_status": (notice_status, NOTICE_STATUS),
    "notice_hosts": (notice_hosts, NOTICE_HOSTS),
    "notice_places": (notice_places, NOTICE_PLACES),
    "notice_values": (notice_values, NOTICE_VALUES),
    "notice_drops": (notice_drops, NOTICE_DROPS),
    "notice_labels": (notice_labels, NOTICE_LABELS),
    "notice_skips": (notice_skips, NOTICE_SKIPS),
    "calendar_pass": (calendar_pass, CALENDAR_PASS),
    "board_views": (board_views, BOARD_VIEWS),
    "published_board": (published_board, PUBLISHED_BOARD),
    "board_meta": (board_meta, BOARD_META),
    "resolver_keys": (resolver_keys, RESOLVER_KEYS),
    "merged_pairs": (merged_pairs, MERGED_PAIRS),
}
