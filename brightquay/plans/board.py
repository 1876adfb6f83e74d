"""Queries over the board: order, scores, text and URL functions, sources, enrichment, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import dates, page, scoring, text
from brightquay.operators import joins, rollups, sampling
from brightquay.session import ship_package
from brightquay.sources import files

#: The instant that queries over orders take as now: 2000-01-01 in UTC.
NOW_MS = 946_684_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_ms(ts: str | Column) -> Column:
    """Milliseconds of a zone-free timestamp, read as UTC, rounded down before 1970 too."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / F.lit(1000))


def board_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next orders from a date on, with their freshness: a top-100 report."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", day_ms("o_orderdate").alias("ms"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"))
    o = o.withColumn("freshness", scoring.freshness(F.col("ms"), F.lit(NOW_MS)))
    return sampling.board_order(o, F.col("ms"), F.lit(NOW_MS), "start", "o_orderkey", 100).select("o_orderkey", "start", "freshness")


BOARD_ORDER = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start,
       CASE WHEN d < 0 THEN 96 WHEN d <= 2 THEN 100 WHEN d <= 7 THEN 92 WHEN d <= 14 THEN 84 WHEN d <= 30 THEN 70 WHEN d <= 60 THEN 55 ELSE 40 END AS freshness
FROM (SELECT *, (epoch_ms(o_orderdate) - 946684800000) / 86400000 AS d FROM orders) WHERE o_orderdate >= TIMESTAMP '2000-01-01' ORDER BY start, o_orderkey LIMIT 100
"""


def freshness_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by step of the freshness ladder."""
    o = table(spark, sf_dir, "orders").select(scoring.freshness(day_ms("o_orderdate"), F.lit(NOW_MS)).alias("freshness"), "o_totalprice")
    return o.groupBy("freshness").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


FRESHNESS = """
SELECT CASE WHEN d < 0 THEN 96 WHEN d <= 2 THEN 100 WHEN d <= 7 THEN 92 WHEN d <= 14 THEN 84 WHEN d <= 30 THEN 70 WHEN d <= 60 THEN 55 ELSE 40 END AS freshness,
       count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT *, (epoch_ms(o_orderdate) - 946684800000) / 86400000 AS d FROM orders) GROUP BY 1
"""


def score_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence flags and scores of documents under a test vocabulary."""
    t = F.col("text")
    flags = {
        "direct": text.has_word(t, "license") | text.has_word(t, "licensed"),
        "build": text.has_word(t, "erst"),
        "compete": text.has_word(t, "token"),
        "negative": t.rlike(r" \| "),
        "local": F.col("lang") == "en",
        "register": t.rlike("@"),
        "prize": t.rlike("[0-9]{16}"),
    }
    d = table(spark, sf_dir, "documents").select("doc_id", *[v.alias(k) for k, v in flags.items()])
    return d.withColumn("s", scoring.candidate_scores(*[F.col(k) for k in flags])).select("doc_id", *flags, "s.confidence", "s.relevance")


SCORE_SIGNALS = """
WITH f AS (SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z])license([^a-z]|$)') OR regexp_matches(lower(text), '(^|[^a-z])licensed([^a-z]|$)') AS direct,
  regexp_matches(lower(text), '(^|[^a-z])erst([^a-z]|$)') AS build, regexp_matches(lower(text), '(^|[^a-z])token([^a-z]|$)') AS compete,
  contains(text, ' | ') AS negative, lang = 'en' AS local, contains(text, '@') AS register, regexp_matches(text, '[0-9]{16}') AS prize FROM documents),
c AS (SELECT *, greatest(0, least(100, CASE WHEN direct THEN 62 ELSE 20 END + build::INT * 16 + compete::INT * 16 - negative::INT * CASE WHEN build AND compete THEN 0 ELSE 30 END)) AS confidence FROM f)
SELECT *, greatest(0, least(100, CAST(floor(confidence * 0.65::DOUBLE + 0.5) AS INT) + local::INT * 20 + register::INT * 8 + prize::INT * 7)) AS relevance FROM c
"""


def board_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scores of parts: table lookup, ladder and weighted sum."""
    p = table(spark, sf_dir, "part")
    conf = scoring.clamp(F.col("p_size") * 2)
    builder = F.least(F.lit(100), 55 + F.col("p_size"))
    access = scoring.looked_up(F.col("p_type"), {"ECONOMY": 90, "STANDARD": 60, "PROMO": 40}, 50, F.when(F.col("p_size") > 25, 8).otherwise(-5))
    return p.select("p_partkey", access.cast("int").alias("accessibility"), scoring.final_score(conf, builder, access, F.lit(70)).alias("score"))


BOARD_SCORES = """
WITH a AS (SELECT *, greatest(0, least(100, CASE p_type WHEN 'ECONOMY' THEN 90 WHEN 'STANDARD' THEN 60 WHEN 'PROMO' THEN 40 ELSE 50 END + CASE WHEN p_size > 25 THEN 8 ELSE -5 END)) AS accessibility FROM part)
SELECT p_partkey, accessibility, CAST(floor(0.4::DOUBLE * least(100, greatest(0, p_size * 2)) + 0.25::DOUBLE * least(100, 55 + p_size) + 0.2::DOUBLE * accessibility + 0.15::DOUBLE * 70 + 0.5::DOUBLE) AS INT) AS score FROM a
"""


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs, slugs and stable ids of pages."""
    p = table(spark, sf_dir, "pages").select("page_id", text.canonical_url("url", schemes=("http", "https")).alias("canonical"))
    return p.select("page_id", "canonical", text.slug_of("canonical").alias("slug"), text.stable_event_id("canonical").alias("stable_id"))


URL_CANONICAL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h,
  regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, s, h, path, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '^(utm_.*|ref|ref_.*|source)$')), '&') AS q FROM p),
u AS (SELECT page_id, CASE WHEN s IN ('http', 'https') THEN s || '://' || h || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical, h, path FROM c)
SELECT page_id, canonical, nullif(regexp_extract(path, '([^/]+)/*$', 1), '') AS slug,
  'external-' || substr(regexp_replace(regexp_replace(lower(h || '-' || path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 54) || '-' || substr(sha256(canonical), 1, 8) AS stable_id FROM u
"""


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages, as its length and hash."""
    t = table(spark, sf_dir, "pages").select("page_id", text.visible_text("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("sha256"))


_NAMED = " ".join(f"WHEN '&{k};' THEN {chr(39)}{v.replace(chr(39), chr(39) * 2)}{chr(39)}" for k, v in text.ENTITIES.items())
_E = r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);"


def _decoded(t: str) -> str:
    """SQL that decodes entities piece by piece."""
    one = rf"CASE lower(e) {_NAMED} ELSE CASE WHEN regexp_matches(e, '^&#[xX]') THEN chr(CAST('0x' || regexp_extract(e, '[0-9A-Fa-f]+;', 0)[:-2] AS INT)) WHEN starts_with(e, '&#') THEN chr(CAST(regexp_extract(e, '\d+') AS INT)) ELSE e END END"
    return f"list_aggregate(list_transform(list_zip(list_concat([''], list_transform(regexp_extract_all({t}, '{_E}'), lambda e: {one})), regexp_split_to_array({t}, '{_E}')), lambda z: z[1] || z[2]), 'string_agg', '')"


def _visible(t: str) -> str:
    """SQL of the visible text."""
    for tag in text.HIDDEN:
        t = rf"regexp_replace({t}, '<{tag}\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    t = rf"regexp_replace(regexp_replace({t}, '<!--.*?-->', ' ', 'gs'), '<br\s*/?>|</({'|'.join(text.ENDS_LINE)})>', chr(10), 'gi')"
    t = _decoded(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[ \t\x{{A0}}\x{{200B}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


VISIBLE_TEXT = f"SELECT page_id, length(t) AS chars, sha256(t) AS sha256 FROM (SELECT page_id, {_visible('html')} AS t FROM pages)"


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.page_title("html").alias("title"))


PAGE_TITLES = rf"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1) AS t FROM pages)
SELECT page_id, trim(regexp_replace({_decoded('t')}, '\s+', ' ', 'g')) AS title FROM t
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.page_links("html")).alias("place", "l")).select("page_id", "place", "l.href", "l.text")


_ATTR = lambda name: rf"regexp_extract(tag, '(?i)\b{name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s>]+))', 1) || regexp_extract(tag, '(?i)\b{name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s>]+))', 2) || regexp_extract(tag, '(?i)\b{name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s>]+))', 3)"
PAGE_LINKS = rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) AS a, unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')))) AS i FROM pages),
t AS (SELECT page_id, i, regexp_extract(a, '(?is)^<a\b([^>]*)>', 1) AS tag, regexp_extract(a, '(?is)^<a\b[^>]*>(.*)</a>$', 1) AS inside FROM a),
v AS (SELECT page_id, i, {_ATTR('href')} AS h, {_ATTR('aria-label')} AS l, {_ATTR('title')} AS c, {_visible('inside')} AS v FROM t),
w AS (SELECT page_id, i, nullif(trim({_decoded('h')}), '') AS href, nullif(trim({_decoded('l')}), '') AS l, nullif(trim({_decoded('c')}), '') AS c, trim(regexp_replace(v, '\s+', ' ', 'g')) AS text FROM v)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS place, href, CASE WHEN length(text) > 1 THEN text ELSE coalesce(l, c, text) END AS text FROM w WHERE href IS NOT NULL
"""


def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of pages read as listings, and the longest text of each link."""
    p = table(spark, sf_dir, "pages")
    cards = p.select("page_id", F.explode(page.listing_cards("html")).alias("c")).select("page_id", "c.*")
    longest = joins.longest_text_per_link(cards, "path", "text", "status").withColumnRenamed("text", "longest")
    return cards.join(longest, "path").select("page_id", "path", "status", "mode", "going", "longest")


LISTING_CARDS = rf"""
WITH l AS ({PAGE_LINKS}), f AS (SELECT page_id, href, text FROM l WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY place) = 1),
c AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)finished') THEN 'finished' WHEN regexp_matches(text, '(?i)\bLIVE\b') THEN 'live' WHEN regexp_matches(text, '(?i)\bTBA\b') THEN 'tba' WHEN regexp_matches(text, '(?i)register') THEN 'upcoming' ELSE 'unknown' END AS status,
  CASE WHEN regexp_matches(text, '(?i)hybrid') THEN 'hybrid' WHEN regexp_matches(text, '(?i)online') THEN 'online' ELSE 'unknown' END AS mode, nullif(CAST(nullif(regexp_extract(text, '\b(\d{{3,6}})\b', 1), '') AS INT), 0) AS going FROM f),
g AS (SELECT href, arg_max(said, (length(said), said)) AS longest FROM (SELECT href, CASE WHEN length(text) > 3 THEN text ELSE status END AS said FROM c) GROUP BY href)
SELECT page_id, c.href AS path, status, mode, going, longest FROM c JOIN g ON c.href = g.href
"""


def feed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' property bodies as a JSON feed, their numbers as epoch seconds."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"models": ['), F.col("props"), F.lit("]}")).alias("body"))
    return e.select("event_id", F.explode(page.feed_entries("body", "struct<k:bigint>")).alias("m")).select("event_id", page.from_seconds(F.col("m.k")).alias("ms"))


FEED_MODELS = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 1000 AS ms FROM events"


def claim_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping lists of orders: the first source's claim wins."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_custkey").alias("ordinal"))
    parts = [o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 200000"), o.filter("o_orderkey % 3 <> 0")]
    return joins.claim_union(parts, "o_orderkey", "ordinal").select("o_orderkey", "source_rank", "o_orderstatus", "ordinal")


CLAIM_UNION = """
WITH u AS (SELECT *, 0 AS source_rank FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT *, 1 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT *, 2 FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, source_rank, o_orderstatus, o_custkey AS ordinal FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY source_rank, o_custkey) = 1
"""


def enrich_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with facts of their last order: facts win the status, the record wins the segment."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"), F.lit("none").alias("status"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("segment"))
    return joins.enrich(c, o, "k", facts_first=["status"], records_first=["segment"])


ENRICH = """
SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, o.segment) AS segment, coalesce(o.status, 'none') AS status
FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS segment FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey
"""


def gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' gaps filled from the earliest order that has a priority of its own."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("venue"), F.lit(None).cast("string").alias("city"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("venue"), F.col("o_orderstatus").alias("city"))
    return joins.gap_fill(c, o, "k", "o_orderkey", "venue", ["venue", "city"], skip=F.col("k") % 7 == 0)


GAP_FILLED = """
WITH o AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS venue, o_orderstatus AS city, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, o_orderkey) = 1)
SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END ELSE coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, o.venue) END AS venue,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE o.city END AS city FROM customer LEFT JOIN o ON c_custkey = o.k
"""


def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation, nations without any included."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return rollups.rollup_with_zeros(n, c, "n_nationkey", rich=F.col("c_acctbal") > 5000, building=F.col("c_mktsegment") == "BUILDING")


REGION_ROLLUP = """
SELECT n_nationkey, count(c_custkey) AS n, count(*) FILTER (WHERE c_acctbal > 5000) AS rich, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1
"""


def density_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers per segment and order status, and over all; a source that failed is null."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bad = o.limit(1).select(F.lit("P").alias("o_orderstatus"))
    return rollups.distinct_by_source(o, "c_mktsegment", "o_orderstatus", "o_custkey", ["F", "O", "P"], bad)


DENSITY = """
SELECT c_mktsegment, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS "F", count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS "O", CAST(NULL AS BIGINT) AS "P", count(DISTINCT o_custkey) AS "all"
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
"""


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, slots, ages, durations and spans of orders."""
    o = table(spark, sf_dir, "orders")
    ms = day_ms("o_orderdate")
    span = dates.all_day_span(F.col("o_orderdate"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 6).cast("int")))
    return o.select(
        "o_orderkey",
        dates.utc_day(ms).alias("day"),
        dates.half_day_slot(ms).alias("slot"),
        dates.age_hours(ms, F.lit(NOW_MS)).alias("age"),
        dates.iso_duration(F.col("o_custkey") * 90_000).alias("duration"),
        F.date_format(span["first"], "yyyyMMdd").alias("first"),
        F.date_format(span["after"], "yyyyMMdd").alias("after"),
        dates.month_group("o_orderdate").alias("month"),
        dates.day_label(F.col("o_orderdate")).alias("label"),
    )


DATE_FUNCTIONS = """
WITH o AS (SELECT *, CAST(floor(o_custkey * 90000 / 60000) AS BIGINT) AS m, CAST(o_orderkey % 6 AS INT) AS k FROM orders),
p AS (SELECT *, CASE WHEN m // 1440 > 0 THEN (m // 1440) || 'D' ELSE '' END AS dd, CASE WHEN m // 60 % 24 > 0 THEN (m // 60 % 24) || 'H' ELSE '' END || CASE WHEN m % 60 > 0 THEN (m % 60) || 'M' ELSE '' END AS clock FROM o)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(o_orderdate) // 43200000 AS slot, (946684800000 - epoch_ms(o_orderdate)) / 3.6e6::DOUBLE AS age,
  CASE WHEN dd || clock = '' THEN 'PT0M' ELSE 'P' || dd || CASE WHEN clock <> '' THEN 'T' || clock ELSE '' END END AS duration,
  strftime(o_orderdate, '%Y%m%d') AS first, strftime(o_orderdate::DATE + CASE WHEN k + 1 > 3 THEN 1 ELSE k + 1 END, '%Y%m%d') AS after, strftime(o_orderdate, '%B %Y') AS month, upper(strftime(o_orderdate, '%b %-d')) AS label
FROM p
"""


def range_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges written out from orders and read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")).alias("b"))
    same, f = F.date_format("a", "yyyyMM") == F.date_format("b", "yyyyMM"), F.date_format
    written = F.when(F.col("o_orderkey") % 20 == 0, f("a", "MMM dd, yyyy")).when(same, F.concat(f("a", "MMM dd"), F.lit(" - "), f("b", "dd, yyyy"))).otherwise(F.concat(f("a", "MMM dd"), F.lit(" - "), f("b", "MMM dd, yyyy")))
    r = dates.parse_range(F.when(F.col("o_orderkey") % 50 == 7, "coming soon").otherwise(written))
    return o.select("o_orderkey", F.date_format(r["start"], "yyyy-MM-dd").alias("start"), F.date_format(r["end"], "yyyy-MM-dd").alias("end"))


RANGE_STRINGS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start, CASE WHEN o_orderkey % 50 <> 7 THEN strftime(o_orderdate::DATE + CAST(o_orderkey % 20 AS INT), '%Y-%m-%d') END AS "end" FROM orders
"""


def ics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calendar entries, before folding."""
    o = table(spark, sf_dir, "orders").withColumn("span", dates.all_day_span(F.col("o_orderdate"), F.col("o_orderdate")))
    title = F.concat(F.col("o_orderpriority"), F.lit(", \\ order; "), F.col("o_orderkey").cast("string"))
    return files.calendar_entries(o, F.col("o_orderkey").cast("string"), title, F.col("span.first"), F.col("span.after"), fold=False).select("o_orderkey", "entry")


ICS_ROWS = r"""
SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || chr(13) || chr(10) || 'SUMMARY:' || o_orderpriority || '\, \\ order\; ' || o_orderkey || chr(13) || chr(10)
  || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(o_orderdate::DATE + 1, '%Y%m%d') || chr(13) || chr(10) || 'END:VEVENT' AS entry FROM orders
"""


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of customers; null and empty differ."""
    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, F.lit("")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", text.content_hash({"name": F.col("c_name"), "segment": segment, "nation": F.col("c_nationkey")}).alias("sha256"))


CONTENT_HASHES = """
SELECT c_custkey, sha256('[["name","' || c_name || '"],["segment",' || CASE c_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE '"' || c_mktsegment || '"' END || '],["nation","' || c_nationkey || '"]]') AS sha256 FROM customer
"""


def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reached from the first suppliers over two steps of shared parts."""
    li = table(spark, sf_dir, "lineitem")
    links = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).union(li.select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))).distinct()
    return joins.links_within(links, spark.range(3).select(F.concat(F.lit("s"), "id").alias("node")), 2)


CRAWL_DEPTH = """
WITH RECURSIVE l AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 's' || i AS node, 0 AS depth FROM range(3) t(i) UNION SELECT dst, depth + 1 FROM r JOIN l ON node = src WHERE depth < 2)
SELECT node, min(depth) AS depth FROM r GROUP BY 1
"""


def longest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page URL the longest known section, host and first folder, that it contains."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    keys = p.select(F.regexp_extract("url", r"^https?://([^/?#]*/[^/?#]*)", 1).alias("path"))
    return joins.contains_join(p, "url", keys, "path", 12).select("page_id", "path")


LONGEST_KEY = r"""
WITH k AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*/[^/?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM pages JOIN k ON length(path) >= 12 AND contains(url, path) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(path) DESC, path DESC) = 1
"""

QUERIES = {
    "board_order": (board_order, BOARD_ORDER),
    "freshness_ladder": (freshness_ladder, FRESHNESS),
    "score_signals": (score_signals, SCORE_SIGNALS),
    "board_scores": (board_scores, BOARD_SCORES),
    "url_canonical": (url_canonical, URL_CANONICAL),
    "visible_text": (visible_text, VISIBLE_TEXT),
    "page_titles": (page_titles, PAGE_TITLES),
    "page_links": (page_links, PAGE_LINKS),
    "listing_cards": (listing_cards, LISTING_CARDS),
    "feed_models": (feed_models, FEED_MODELS),
    "claim_union": (claim_union, CLAIM_UNION),
    "enrich_coalesce": (enrich_coalesce, ENRICH),
    "gap_filled": (gap_filled, GAP_FILLED),
    "region_rollup": (region_rollup, REGION_ROLLUP),
    "density_pivot": (density_pivot, DENSITY),
    "date_functions": (date_functions, DATE_FUNCTIONS),
    "range_strings": (range_strings, RANGE_STRINGS),
    "ics_rows": (ics_rows, ICS_ROWS),
    "content_hashes": (content_hashes, CONTENT_HASHES),
    "crawl_depth": (crawl_depth, CRAWL_DEPTH),
    "longest_key": (longest_key, LONGEST_KEY),
}
