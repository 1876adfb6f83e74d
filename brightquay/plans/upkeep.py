"""Queries over upkeep: calendars and ledgers, seeds and crawls, texts, plurals, folded lines, rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import dates, scoring, text
from brightquay.operators import graph, joins, resolve, sampling
from brightquay.plans.board import NOW_MS, day_ms, table
from brightquay.sources import files

OWN_HOST = "cal.example"


def calendar_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board entries on a calendar, by slug where they have one, else by title; what the ledger has to adopt or clear; what is pending."""
    p = table(spark, sf_dir, "part")
    host = F.when(F.col("p_size") % 2 == 0, OWN_HOST).otherwise("other.example")
    title = F.concat("p_name", F.lit(" No. "), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("!"))
    url = F.concat(F.lit("https://"), host, F.lit("/ev-"), F.col("p_partkey").cast("string"), F.lit("/"))
    board = p.select(F.col("p_partkey").alias("id"), "p_size", "p_brand", text.title_fingerprint(title).alias("key"), F.when(text.single_segment(url, (OWN_HOST,)), text.slug_of(url)).alias("slug")).persist()
    shown = F.when(F.col("p_size") % 3 == 0, F.expr("substring(key, 1, length(key) - 1)")).otherwise(F.col("key"))
    calendar = board.filter("p_size < 20").select("slug", shown.alias("key"))
    present = joins.slug_or_key_join(board, calendar).select("id")
    synced, submitted = board.filter("p_size % 5 < 2").select("id"), board.filter("p_brand < 'Brand#2'").select("id")
    out = board.select("id").join(present.distinct().withColumn("present", F.lit(True)).hint("merge"), "id", "left").join(joins.ledger_check(synced, present).hint("merge"), "id", "left")
    waiting = joins.pending(board, synced, submitted).select("id", F.lit(True).alias("pending"))
    return out.join(waiting.hint("merge"), "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"), "action", F.coalesce("pending", F.lit(False)).alias("pending"))


CALENDAR_STATE = """
WITH b AS (SELECT p_partkey AS id, p_size, p_brand, lower(regexp_replace(p_name || 'No' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '[^A-Za-z0-9]', '', 'g')) AS key, CASE WHEN p_size % 2 = 0 THEN 'ev-' || p_partkey END AS slug FROM part),
c AS (SELECT slug, CASE WHEN p_size % 3 = 0 THEN left(key, length(key) - 1) ELSE key END AS key FROM b WHERE p_size < 20),
k AS (SELECT DISTINCT key FROM c),
p AS (SELECT id FROM b WHERE slug IN (SELECT slug FROM c WHERE slug IS NOT NULL)
  UNION SELECT id FROM b JOIN k ON b.slug IS NULL AND (b.key = k.key OR (length(b.key) >= 18 AND length(k.key) >= 18 AND (contains(b.key, k.key) OR contains(k.key, b.key)))))
SELECT id, id IN (SELECT id FROM p) AS present,
  CASE WHEN id IN (SELECT id FROM p) THEN CASE WHEN p_size % 5 < 2 THEN 'keep' ELSE 'adopt' END WHEN p_size % 5 < 2 THEN 'clear' END AS action,
  p_size % 5 >= 2 AND p_brand >= 'Brand#2' AS pending FROM b
"""


def seed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by tier, each nation's first three ahead of the others, and which are among the first sixty by promise."""
    s = table(spark, sf_dir, "supplier").withColumn("seen_ms", F.when(F.col("s_nationkey") > 0, F.lit(NOW_MS) - F.col("s_nationkey").cast("long") * 43_200_000)).withColumn("promising", F.col("s_acctbal") > 5000)
    t = sampling.triage(s, F.col("promising"), F.col("seen_ms"), F.lit(NOW_MS))
    t = sampling.reserve_order(t, "s_nationkey", "s_suppkey", 3)
    first = sampling.promising_first(s, "promising", "s_suppkey", 60).select("s_suppkey", F.lit(True).alias("first"))
    return t.join(first, "s_suppkey", "left").select("s_suppkey", "tier", F.col("turn.late").alias("late"), F.coalesce("first", F.lit(False)).alias("first"))


SEED_QUEUE = """
SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_nationkey > 0 AND s_nationkey * 43200000 <= 259200000 THEN 1 ELSE 2 END AS tier,
  CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 3 THEN 0 ELSE 1 END AS late,
  row_number() OVER (ORDER BY s_acctbal > 5000 DESC, s_suppkey) <= 60 AS first FROM supplier
"""


def budgeted_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that a crawl of two rounds visits within 300 pages, with a reserve for two of three regions."""
    li = table(spark, sf_dir, "lineitem")
    links = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).union(li.select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))).distinct()
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("r"), F.col("s_nationkey") % 3).alias("region"), F.col("s_nationkey").cast("int").alias("priority"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.concat(F.lit("r"), F.col("p_size") % 3).alias("region"), F.col("p_size").cast("int").alias("priority"))
    seeds = spark.range(3).select(F.concat(F.lit("s"), "id").alias("node"))
    reserve = spark.createDataFrame([("r1", 60), ("r2", 40)], "region string, pages int")
    return graph.crawl(links, s.unionByName(p), seeds, 2, 300, reserve).select("node", "depth", "region", "turn")


_ROUND = lambda f, v: f"""SELECT node, region, priority, CASE WHEN region IN ('r1', 'r2') AND row_number() OVER (PARTITION BY region ORDER BY priority DESC NULLS LAST, node) <= CASE region WHEN 'r1' THEN 60 ELSE 40 END - (SELECT count(*) FROM {v} v WHERE v.region = {f}.region) THEN 0 ELSE 1 END AS late FROM {f}"""
_TURN = "row_number() OVER (ORDER BY late, priority DESC NULLS LAST, node)"
BUDGETED_CRAWL = f"""
WITH l AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
n AS (SELECT 's' || s_suppkey AS node, 'r' || s_nationkey % 3 AS region, s_nationkey AS priority FROM supplier UNION ALL SELECT 'p' || p_partkey, 'r' || p_size % 3, p_size FROM part),
none AS (SELECT * FROM n WHERE false), f0 AS (SELECT 's' || i AS node, region, priority FROM range(3) t(i) LEFT JOIN n ON node = 's' || i), q0 AS ({_ROUND('f0', 'none')}),
v0 AS (SELECT node, region, 0 AS depth, {_TURN} AS turn FROM q0),
g1 AS (SELECT DISTINCT d.node, n.region, n.priority FROM (SELECT dst AS node FROM l WHERE src IN (SELECT node FROM v0) AND dst NOT IN (SELECT node FROM v0)) d LEFT JOIN n USING (node)), q1 AS ({_ROUND('g1', 'v0')}),
w1 AS (SELECT node, region, 1 AS depth, {_TURN} AS turn FROM q1), v1 AS (SELECT * FROM v0 UNION ALL SELECT * FROM w1 WHERE turn <= 300 - (SELECT count(*) FROM v0)),
g2 AS (SELECT DISTINCT d.node, n.region, n.priority FROM (SELECT dst AS node FROM l WHERE src IN (SELECT node FROM v1 WHERE depth = 1) AND dst NOT IN (SELECT node FROM v1)) d LEFT JOIN n USING (node)), q2 AS ({_ROUND('g2', 'v1')}),
w2 AS (SELECT node, region, 2 AS depth, {_TURN} AS turn FROM q2)
SELECT node, depth, region, CAST(turn AS INT) AS turn FROM v1 UNION ALL SELECT node, depth, region, CAST(turn AS INT) FROM w2 WHERE turn <= 300 - (SELECT count(*) FROM v1)
"""


def merged_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the longest priority and all states of the orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.array("o_orderstatus").alias("surfaces"))
    return resolve.longest_text(o, "o_custkey", "o_orderpriority", "surfaces").select("o_custkey", "o_orderpriority", F.array_join("surfaces", ",").alias("surfaces"))


MERGED_SURFACES = "SELECT o_custkey, arg_max(o_orderpriority, (length(o_orderpriority), o_orderpriority)) AS o_orderpriority, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS surfaces FROM orders GROUP BY 1"


def stated_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest amount in a text, and the sum of three where there are exactly three."""
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("Prizes $"), F.format_number("p_retailprice", 2), F.lit(" and $"), F.col("p_size").cast("string"), F.lit("k, runner-up $ 250"), F.when(F.col("p_size") % 3 == 0, ", or $1.5M").otherwise(""))
    got = p.select("p_partkey", text.amounts(F.when(F.col("p_size") % 7 == 0, "no prize").otherwise(said)).alias("a"))
    return got.select("p_partkey", F.array_max("a").alias("most"), F.round(text.sum_of_first(F.col("a"), 3), 2).alias("three"))


STATED_MONEY = """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 1500000.0 ELSE greatest(round(p_retailprice, 2), p_size * 1000, 250) END::DOUBLE AS most,
  CASE WHEN p_size % 7 > 0 AND p_size % 3 > 0 THEN round(round(p_retailprice, 2) + p_size * 1000 + 250, 2) END::DOUBLE AS three FROM part
"""


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and previews of pages: title key, permalink, refusal, what stands around the first link, evidence."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    title = F.concat(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.when(F.col("page_id") % 3 == 0, " - Open Registration").otherwise(" (Forbidden)"))
    window = text.context_window("html", F.lit("<p>"), 26, 16)
    evidence = text.join_filled("\n", F.lit("kind"), F.when(F.col("page_id") % 2 == 0, "").otherwise("odd"), F.lit(None).cast("string"), F.substring("url", 1, 30))
    return p.select("page_id", text.event_key(title).alias("key"), text.looks_refused(title, F.col("html"), F.lit(1)).alias("refused"), text.single_segment(F.regexp_replace("url", r"/[0-9].*", ""), ("m.ththth.example.net", "blog.tionsh.example.com")).alias("permalink"), window.alias("around"), evidence.alias("evidence"))


PAGE_KEYS = r"""
WITH p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, strpos(html, '<p>') AS pos, greatest(1, strpos(html, '<p>') - 26) AS first FROM pages)
SELECT page_id, trim(regexp_replace(lower(host || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' (Forbidden)' END), '[^a-z0-9]+', ' ', 'g')) AS key, page_id % 3 > 0 AS refused,
  lower(host) IN ('m.ththth.example.net', 'blog.tionsh.example.com') AND regexp_matches(regexp_replace(url, '/[0-9].*', ''), '^[a-z]+://[^/?#]*/[^/?#]+/?([?#].*)?$') AS permalink,
  CASE WHEN pos > 0 THEN substr(html, first, pos - first + 19) END AS around, 'kind' || chr(10) || CASE WHEN page_id % 2 = 0 THEN '' ELSE 'odd' || chr(10) END || left(url, 30) AS evidence FROM p
"""


def month_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in order of time, a heading where the month changes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), dates.month_group(F.col("o_orderdate")).alias("month"))
    return sampling.headed(o, "o_custkey", "at", "month").select("o_orderkey", "header")


MONTH_HEADERS = """
SELECT o_orderkey, CASE WHEN m IS DISTINCT FROM lag(m) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) THEN m END AS header FROM (SELECT *, strftime(o_orderdate, '%B %Y') AS m FROM orders)
"""


def structured_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated starts and ends: both have to parse, and the end has to be later."""
    o = table(spark, sf_dir, "orders")
    iso = lambda hours: F.date_format(F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(hours=hours), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("o_orderkey") % 6
    start = F.when(k == 0, "soon").otherwise(iso(F.lit(9)))
    end = F.when(k == 1, F.lit(None)).when(k == 2, iso(F.lit(9))).otherwise(iso(F.lit(9) + k))
    return o.select("o_orderkey", dates.structured_schedule(start, end).alias("s")).select("o_orderkey", "s.start", "s.end")


STRUCTURED_TIMES = """
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, epoch_ms(o_orderdate) + 32400000 AS s FROM orders)
SELECT o_orderkey, CASE WHEN k > 2 THEN s END AS start, CASE WHEN k > 2 THEN s + k * 3600000 END AS "end" FROM o
"""


def fixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding of exact binary values: to four places of thirds, and of thirty-seconds, which are halves of the last place."""
    li = table(spark, sf_dir, "lineitem")
    third = F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double") / 3
    return li.select("l_orderkey", "l_linenumber", "l_partkey", scoring.fixed_places(third, 4).alias("third"), scoring.fixed_places(third, 2).alias("short"), scoring.fixed_places(-F.col("l_quantity").cast("double") / 32, 4).alias("half"))


FIXED_VALUES = """
WITH l AS (SELECT *, CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) / 3 AS x, CAST(l_quantity AS DOUBLE) / 32 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.4f', x) AS DOUBLE) AS third, CASE WHEN x * 8 = floor(x * 8) THEN floor(x * 100 + 0.5) / 100 ELSE CAST(printf('%.2f', x) AS DOUBLE) END AS short, -(floor(h * 10000 + 0.5) / 10000) AS half FROM l
"""


def folded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar entries with long titles of one, two, three and four bytes a character, folded."""
    p = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.repeat(F.concat(F.lit(" été 日本 \U0001f47e "), F.col("p_partkey").cast("string")), F.col("p_size").cast("int") % 9))
    day = F.lit("2000-01-01").cast("date")
    return files.calendar_entries(p, F.col("p_partkey").cast("string"), title, day, F.date_add(day, 1)).select("p_partkey", "entry")


FOLDED_ENTRIES = """
WITH RECURSIVE t AS (SELECT p_partkey, 'SUMMARY:' || p_name || repeat(' été 日本 \U0001f47e ' || p_partkey, CAST(p_size AS INT) % 9) AS line FROM part),
f AS (SELECT p_partkey, line, 0 AS i, '' AS done, 0 AS used, 75 AS room FROM t
  UNION ALL SELECT p_partkey, line, i + 1, CASE WHEN used + n > room THEN done || chr(13) || chr(10) || ' ' || c ELSE done || c END, CASE WHEN used + n > room THEN n ELSE used + n END, CASE WHEN used + n > room THEN 74 ELSE room END
  FROM (SELECT *, substr(line, i + 1, 1) AS c, octet_length(encode(substr(line, i + 1, 1))) AS n FROM f WHERE i < length(line)))
SELECT p_partkey, array_to_string(['BEGIN:VEVENT', 'UID:' || p_partkey, done, 'DTSTART;VALUE=DATE:20000101', 'DTEND;VALUE=DATE:20000102', 'END:VEVENT'], chr(13) || chr(10)) AS entry FROM f WHERE i = length(line)
"""

MESSAGES = {
    "en/left.one": "{count} day left for {name}", "en/left.other": "{count} days left for {name}", "en/only": "Only here, {name}", "es/left.one": "queda {count} día para {name}", "es/left.other": "quedan {count} días para {name}",
    "pl/left.one": "został {count} dzień", "pl/left.few": "zostały {count} dni", "pl/left.many": "zostało {count} dni", "es/left.many": "quedan {count} de días",
}


def plural_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in three languages with their plural forms, and where forms, keys or languages are missing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.element_at(F.array(*map(F.lit, ("en", "es", "pl", "xx"))), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("language"), F.when(F.col("c_custkey") % 50 == 0, F.lit(2_000_000)).otherwise(F.col("c_custkey") * F.when(F.col("c_custkey") % 3 == 0, 7919).otherwise(1)).cast("long").alias("n"))
    catalog = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    left = text.plural_text(catalog, F.col("language"), F.lit("left"), F.col("n"), {"name": F.col("c_name")})
    only = text.template(text.catalog_text(catalog, F.col("language"), F.lit("only")), {"name": F.col("c_name")})
    return c.select("c_custkey", left.alias("left"), only.alias("only"), text.plural_text(catalog, F.col("language"), F.lit("none"), F.col("n")).alias("none"))


_MARK = lambda mark, least: f"CASE WHEN n < {least} THEN CAST(n AS VARCHAR) ELSE replace(format('{{:,}}', n), ',', '{mark}') END"
PLURAL_MESSAGES = f"""
WITH c AS (SELECT c_custkey, c_name, c_nationkey % 4 AS l, CASE WHEN c_custkey % 50 = 0 THEN 2000000 WHEN c_custkey % 3 = 0 THEN c_custkey * 7919 ELSE c_custkey END AS n FROM customer)
SELECT c_custkey, CASE l
  WHEN 1 THEN CASE WHEN n = 1 THEN 'queda ' || n || ' día para ' || c_name WHEN n <> 0 AND n % 1000000 = 0 THEN 'quedan ' || {_MARK('.', 10000)} || ' de días' ELSE 'quedan ' || {_MARK('.', 10000)} || ' días para ' || c_name END
  WHEN 2 THEN CASE WHEN n = 1 THEN 'został ' || n || ' dzień' WHEN n % 10 BETWEEN 2 AND 4 AND NOT n % 100 BETWEEN 12 AND 14 THEN 'zostały ' || {_MARK(chr(160), 10000)} || ' dni' ELSE 'zostało ' || {_MARK(chr(160), 10000)} || ' dni' END
  WHEN 0 THEN {_MARK(',', 1000)} || CASE WHEN n = 1 THEN ' day' ELSE ' days' END || ' left for ' || c_name
  ELSE {_MARK(',', 1000)} || ' days left for ' || c_name END AS "left", 'Only here, ' || c_name AS only, 'none.other' AS none FROM c
"""

QUERIES = {
    "calendar_state": (calendar_state, CALENDAR_STATE),
    "seed_queue": (seed_queue, SEED_QUEUE),
    "budgeted_crawl": (budgeted_crawl, BUDGETED_CRAWL),
    "merged_surfaces": (merged_surfaces, MERGED_SURFACES),
    "stated_money": (stated_money, STATED_MONEY),
    "page_keys": (page_keys, PAGE_KEYS),
    "month_headers": (month_headers, MONTH_HEADERS),
    "structured_times": (structured_times, STRUCTURED_TIMES),
    "fixed_values": (fixed_values, FIXED_VALUES),
    "folded_entries": (folded_entries, FOLDED_ENTRIES),
    "plural_messages": (plural_messages, PLURAL_MESSAGES),
}
