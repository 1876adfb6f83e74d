"""Queries over records: resolution, snapshots, seeds, limits and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import text
from brightquay.operators import publish, resolve, rollups, sampling, snapshots
from brightquay.plans import notices
from brightquay.plans.board import NOW_MS, day_ms, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices as records to be compared: fingerprint and words of the title, local day, host and area."""
    n = publish.resolvers(notices.notices(spark, sf_dir), notices.REGIONS, notices.ZONE)
    return n.select(F.col("id").alias("ordinal"), "day", text.title_fingerprint("title").alias("fingerprint"), F.array_sort(text.title_words("title")).alias("words"), "host", "area", "confidence", "venue")


def same_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are the same event as an earlier one: the least of these, with the reason."""
    return resolve.first_matches(_records(spark, sf_dir))


_RECORDS = f"""
{notices.N}, k AS ({notices.RESOLVER_KEYS.replace("WITH " + notices.N + ",", "WITH")}),
e AS (SELECT id AS ordinal, day, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS fingerprint, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS words, host, area FROM n JOIN k USING (id) WHERE day IS NOT NULL),
p AS (SELECT y.ordinal, x.ordinal AS a, CASE WHEN least(length(x.fingerprint), length(y.fingerprint)) >= 12 AND (contains(x.fingerprint, y.fingerprint) OR contains(y.fingerprint, x.fingerprint)) THEN 0
  WHEN x.area = '' OR x.area <> y.area THEN NULL WHEN x.host <> '' AND x.host = y.host THEN 1
  WHEN (len(x.words) >= 4 AND len(list_filter(x.words, lambda w: NOT list_contains(y.words, w))) = 0) OR (len(y.words) >= 4 AND len(list_filter(y.words, lambda w: NOT list_contains(x.words, w))) = 0) THEN 2 END AS k
  FROM e x JOIN e y ON x.day = y.day AND x.ordinal < y.ordinal),
m AS (SELECT ordinal, min(a) AS root, arg_min(k, a) AS k FROM p WHERE k IS NOT NULL GROUP BY ordinal)
"""
SAME_EVENTS = f"WITH {_RECORDS} SELECT ordinal, root, ['title', 'host', 'words'][k + 1] AS reason FROM m"


def event_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's first direct match, or itself."""
    r = _records(spark, sf_dir)
    return resolve.first_match_roots(resolve.first_matches(r), r)


EVENT_ROOTS = f"WITH {_RECORDS} SELECT n.id AS ordinal, coalesce(m.root, n.id) AS root FROM n LEFT JOIN m ON n.id = m.ordinal"


def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold, component by component: a record merges into the first kept one that is the same event."""
    r = _records(spark, sf_dir).withColumn("merged", F.lit(1)).persist()

    def merge(a: dict, b: dict) -> dict:
        base, other = (b, a) if b["confidence"] > a["confidence"] else (a, b)
        return base | {"venue": base["venue"] or other["venue"], "ordinal": a["ordinal"], "merged": a["merged"] + b["merged"]}

    return resolve.component_fold(r, resolve.match_links(r), resolve.same_event, merge).select("ordinal", "day", "fingerprint", "venue", "merged")


_SAME = """CASE WHEN least(length(x.fingerprint), length(fingerprint)) >= 12 AND (contains(x.fingerprint, fingerprint) OR contains(fingerprint, x.fingerprint)) THEN true
    WHEN x.area = '' OR x.area <> area THEN false WHEN x.host <> '' AND x.host = host THEN true
    ELSE (len(x.words) >= 4 AND len(x.words) <= len(words) AND len(list_filter(x.words, lambda w: NOT list_contains(words, w))) = 0)
      OR (len(words) >= 4 AND len(words) <= len(x.words) AND len(list_filter(words, lambda w: NOT list_contains(x.words, w))) = 0) END"""
GREEDY_MERGE = f"""
WITH RECURSIVE {_RECORDS.strip()},
q AS (SELECT n.id AS ordinal, k.day, lower(regexp_replace(n.title, '[^A-Za-z0-9]', '', 'g')) AS fingerprint, list_distinct(regexp_extract_all(lower(n.title), '[a-z0-9]+')) AS words, coalesce(k.host, '') AS host, coalesce(k.area, '') AS area, n.confidence, n.venue FROM n JOIN k USING (id)),
z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ordinal) AS i FROM q WHERE day IS NOT NULL),
g AS (
  SELECT day, i, [{{'ordinal': ordinal, 'fingerprint': fingerprint, 'words': words, 'host': host, 'area': area, 'confidence': confidence, 'venue': venue, 'merged': 1}}] AS kept FROM z WHERE i = 1
  UNION ALL
  SELECT day, i, CASE WHEN hit IS NULL THEN list_append(kept, own) ELSE list_transform(kept, lambda x, j: CASE WHEN j <> hit THEN x WHEN confidence > x.confidence
    THEN struct_update(own, ordinal := x.ordinal, venue := coalesce(nullif(venue, ''), x.venue), merged := x.merged + 1) ELSE struct_update(x, venue := coalesce(nullif(x.venue, ''), venue), merged := x.merged + 1) END) END
  FROM (SELECT z.*, g.kept, {{'ordinal': ordinal, 'fingerprint': fingerprint, 'words': words, 'host': host, 'area': area, 'confidence': confidence, 'venue': venue, 'merged': 1}} AS own,
      list_filter(list_transform(kept, lambda x, j: CASE WHEN {_SAME} THEN j END), lambda j: j IS NOT NULL)[1] AS hit
    FROM g JOIN z ON z.day = g.day AND z.i = g.i + 1)
), last AS (SELECT day, arg_max(kept, i) AS kept FROM g GROUP BY day)
SELECT x.ordinal, day, x.fingerprint, x.venue, x.merged FROM (SELECT day, unnest(kept) AS x FROM last) UNION ALL SELECT ordinal, NULL, fingerprint, venue, 1 FROM q WHERE day IS NULL
"""


def best_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part type and brand the dearest part, with the name of the longest name."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("key"), "p_partkey", "p_retailprice", F.col("p_name").alias("evidence"), F.col("p_type").alias("category"))
    return resolve.best_by_title(p, "key", "p_retailprice", "evidence", "category", "p_partkey")


BEST_RECORDS = """
WITH p AS (SELECT *, p_type || '/' || p_brand AS key FROM part),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_retailprice DESC, p_partkey) = 1),
e AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(p_name) DESC, p_partkey) = 1)
SELECT r.key, r.p_partkey, r.p_retailprice, e.p_name AS evidence, e.p_type AS category FROM r JOIN e USING (key)
"""


def _previous(o: DataFrame) -> DataFrame:
    return o.filter("o_orderkey % 10 <> 1").withColumn("missed", F.when(F.col("o_orderkey") % 20 == 0, 3).otherwise(0))


def _current(o: DataFrame) -> DataFrame:
    edited = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return o.filter("o_orderkey % 10 <> 0").withColumn("o_orderstatus", edited).withColumn("o_orderpriority", price)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", day_ms("o_orderdate").alias("ms"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of orders: added, present, carried and removed rows."""
    o = _orders(spark, sf_dir)
    out = snapshots.reconcile(_previous(o), _current(o), "o_orderkey", F.col("p.ms") < NOW_MS, 3)
    return out.select("o_orderkey", "state", "missed", "o_orderstatus", "o_orderpriority")


RECONCILE = """
WITH p AS (SELECT *, epoch_ms(o_orderdate) AS ms, CASE WHEN o_orderkey % 20 = 0 THEN 3 ELSE 0 END AS missed FROM orders WHERE o_orderkey % 10 <> 1),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS pr FROM orders WHERE o_orderkey % 10 <> 0)
SELECT coalesce(c.o_orderkey, p.o_orderkey) AS o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NOT NULL THEN 'present' WHEN p.ms < 946684800000 OR p.missed + 1 > 3 THEN 'removed' ELSE 'carried' END AS state,
  CASE WHEN c.o_orderkey IS NOT NULL THEN 0 ELSE p.missed + 1 END AS missed, CASE WHEN c.o_orderkey IS NOT NULL THEN s ELSE o_orderstatus END AS o_orderstatus, CASE WHEN c.o_orderkey IS NOT NULL THEN pr ELSE o_orderpriority END AS o_orderpriority
FROM p FULL JOIN c ON p.o_orderkey = c.o_orderkey
"""


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked fields that changed between the snapshots."""
    o = _orders(spark, sf_dir)
    return snapshots.field_changes(_previous(o), _current(o), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


FIELD_CHANGES = """
WITH c AS (SELECT * FROM orders WHERE o_orderkey % 10 > 1)
SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS was, 'X' AS now FROM c WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, NULL FROM c WHERE o_orderkey % 11 = 0
"""


def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that came or went between the snapshots."""
    o = _orders(spark, sf_dir)
    return snapshots.change_set(_previous(o), _current(o), "o_orderkey")


CHANGE_SET = "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'added' ELSE 'removed' END AS change FROM orders WHERE o_orderkey % 10 <= 1"


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with deleted keys out and redacted priorities."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    t = o.filter("o_orderkey % 6 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 12 == 0, "delete").otherwise("redact").alias("action"), F.array(F.lit("o_orderpriority")).alias("fields"))
    out = snapshots.apply_tombstones(o, t, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("redacted", F.array_join("redacted", ","))


TOMBSTONES = """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN '[redacted]' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN 'o_orderpriority' ELSE '' END AS redacted FROM orders WHERE o_orderkey % 12 <> 0
"""


def merge_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of customers: newer values win, keyed lists are merged."""
    c = table(spark, sf_dir, "customer")
    lists = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    older = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit("old").alias("version"), lists("a", "1", "b", "2").alias("m"))
    newer = c.filter("c_custkey % 3 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("segment"), F.lit("new").alias("version"), lists("b", "3", "c", "4").alias("m"))
    out = snapshots.merge_seeds(older, newer, "c_custkey", ["segment", "version"], ["m"])
    return out.withColumn("m", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))


MERGE_SEEDS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN 'NEW' WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 1 THEN 'new' ELSE 'old' END AS version,
  CASE c_custkey % 3 WHEN 0 THEN 'b=3,c=4' WHEN 1 THEN 'a=1,b=2' ELSE 'a=1,b=3,c=4' END AS m FROM customer
"""


def collapse_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts per year against the year before: which falls would stop a publication."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("now"))
    before = o.select((F.col("year") + 1).alias("year"), F.col("now").alias("previous"))
    return snapshots.collapse_guard(o.join(before, "year").select("year", "previous", "now"))


COLLAPSE_GUARD = """
WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS now FROM orders GROUP BY 1)
SELECT o.year, b.now AS previous, o.now, CAST(greatest(12, ceil(b.now * 0.5)) AS BIGINT) AS least, b.now > 0 AND o.now < greatest(12, ceil(b.now * 0.5)) AS refuse FROM o JOIN o b ON o.year = b.year + 1
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of suppliers after a round of outcomes."""
    s = table(spark, sf_dir, "supplier")
    old = s.filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.lit("failed").alias("state"), (F.col("s_suppkey") % 3).cast("int").alias("attempts"), F.lit("m").alias("message"))
    new = s.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("synced"), F.lit("submitted"), F.lit("failed")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("outcome"), F.repeat("s_name", 20).alias("message"))
    return snapshots.ledger_transition(old, new)


LEDGER = """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN ['synced', 'submitted', 'failed'][s_suppkey % 3 + 1] ELSE 'failed' END AS state,
  CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 3 = 2 THEN CASE WHEN s_suppkey % 4 <> 0 THEN 2 ELSE 0 END + 1 ELSE 0 END ELSE CAST(s_suppkey % 3 AS INT) END AS attempts,
  CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 3 <> 0 THEN substr(repeat(s_name, 20), 1, 300) END ELSE 'm' END AS message
FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 4 <> 0
"""


def rotation_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that a slot is due, wrapping over all."""
    p = table(spark, sf_dir, "part")
    return sampling.rotate(p, "p_partkey", p.count(), 150, 13).select("p_partkey", "p_name")


ROTATION_SLICE = "SELECT p_partkey, p_name FROM part WHERE ((p_partkey - (13 * 150) % (SELECT count(*) FROM part)) % (SELECT count(*) FROM part) + (SELECT count(*) FROM part)) % (SELECT count(*) FROM part) < 150"


def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part of every brand but the default in turn, the default brand for the rest."""
    return sampling.stratified(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "Brand#1", "p_partkey", 40, 5)


STRATIFIED = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n, (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand <> 'Brand#1') AS others FROM part)
SELECT p_partkey, p_brand FROM r WHERE CASE WHEN p_brand <> 'Brand#1' THEN i = 5 % n ELSE (i - (5 * greatest(0, 40 - others)) % n + n) % n < greatest(0, 40 - others) END
"""


def retention_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen within 21 days of the last event, in order of their name, at most 60."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(day_ms("ts")).alias("seen"))
    seen = F.when(F.col("user_id") % 10 > 0, F.col("seen"))
    named = e.withColumn("url", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return sampling.retain(named, seen, F.lit(1_706_745_600_000), 21, "url", 60).select("user_id", "url")


RETENTION_CAP = """
SELECT user_id, 'u' || user_id AS url FROM (SELECT user_id, max(epoch_ms(ts)) AS seen FROM events GROUP BY 1) WHERE user_id % 10 = 0 OR seen >= 1706745600000 - 21 * 86400000 ORDER BY url LIMIT 60
"""


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that came closest to a price, without those that reached it: a top-60 report."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(400000) - F.col("o_totalprice")).alias("short"), F.col("o_custkey").alias("relevance"))
    return sampling.near_misses(o, o.filter("short <= 0"), "o_orderkey", "short", "relevance")


NEAR_MISSES = "SELECT o_orderkey, 400000 - o_totalprice AS short, o_custkey AS relevance FROM orders WHERE o_totalprice < 400000 ORDER BY short, relevance DESC, o_orderkey LIMIT 60"


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over suppliers as sources, by severity."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("source"),
        (F.col("s_suppkey") % 7).alias("n"),
        F.lit(3).alias("floor"),
        (F.lit(NOW_MS) - F.col("s_suppkey") * 7_200_000).alias("last_ms"),
        F.when(F.col("s_suppkey") % 11 == 0, "HTTP 429").when(F.col("s_suppkey") % 13 == 0, "HTTP 401").alias("error"),
    )
    return rollups.severities(rollups.health_rules(s, F.lit(NOW_MS))).select("severity", "n", F.sha2(F.array_join("messages", "\n"), 256).alias("messages"))


HEALTH = """
WITH s AS (SELECT s_name, s_suppkey AS k FROM supplier),
m AS (SELECT 'failure' AS severity, s_name || ': stale' AS m FROM s WHERE k * 2 > 36 UNION ALL SELECT 'failure', s_name || ': below floor' FROM s WHERE k % 7 < 3
  UNION ALL SELECT 'failure', s_name || ': misconfigured' FROM s WHERE k % 11 <> 0 AND k % 13 = 0 UNION ALL SELECT 'warning', s_name || ': throttled' FROM s WHERE k % 11 = 0 UNION ALL SELECT 'note', s_name || ': empty' FROM s WHERE k % 7 = 0)
SELECT severity, count(*) AS n, sha256(string_agg(m, chr(10) ORDER BY m)) AS messages FROM m GROUP BY 1
"""

QUERIES = {
    "same_events": (same_events, SAME_EVENTS),
    "event_roots": (event_roots, EVENT_ROOTS),
    "greedy_merge": (greedy_merge, GREEDY_MERGE),
    "best_records": (best_records, BEST_RECORDS),
    "reconcile": (reconcile, RECONCILE),
    "field_changes": (field_changes, FIELD_CHANGES),
    "change_set": (change_set, CHANGE_SET),
    "tombstones": (tombstones, TOMBSTONES),
    "merge_seeds": (merge_seeds, MERGE_SEEDS),
    "collapse_guard": (collapse_guard, COLLAPSE_GUARD),
    "ledger": (ledger, LEDGER),
    "rotation_slice": (rotation_slice, ROTATION_SLICE),
    "stratified_pick": (stratified_pick, STRATIFIED),
    "retention_cap": (retention_cap, RETENTION_CAP),
    "near_misses": (near_misses, NEAR_MISSES),
    "health": (health, HEALTH),
}
