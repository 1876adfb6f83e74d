"""Queries over telemetry and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import scoring
from brightquay.operators import joins, ranking, telemetry
from brightquay.plans.board import day_ms, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", day_ms("ts"))


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by session: a day's silence ends one."""
    return telemetry.gap_sessions(_events(spark, sf_dir), ["user_id"], F.col("ms"), 86_400_000).select("event_id", "user_id", "session")


SESSION_GAPS = """
WITH g AS (SELECT *, (epoch_us(ts) // 1000) AS ms, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000)) AS p FROM events)
SELECT event_id, user_id, sum(CASE WHEN p IS NULL OR ms - p > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM g
"""


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists shown at once: a position that comes again, or a silence, begins a new one."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("client_id"), F.floor(F.col("ms") / 86_400_000).alias("session_id"), F.col("ms").alias("ts"), (F.col("event_id") % 4).alias("position"), "event_id")
    return telemetry.renders(e, gap_ms=6 * 3_600_000).select("client_id", "session_id", "render", "ts", F.size("items").alias("shown"))


RENDERS = """
WITH RECURSIVE e AS (
  SELECT user_id, ms // 86400000 AS session_id, ms, position, row_number() OVER (PARTITION BY user_id, ms // 86400000 ORDER BY ms, position, CAST(event_id AS VARCHAR)) AS i
  FROM (SELECT *, epoch_us(ts) // 1000 AS ms, event_id % 4 AS position FROM events)
), r AS (
  SELECT user_id, session_id, i, ms, [position] AS seen, 1 AS render FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.session_id, e.i, e.ms, CASE WHEN list_contains(r.seen, e.position) OR e.ms - r.ms > 21600000 THEN [e.position] ELSE list_append(r.seen, e.position) END,
    r.render + CASE WHEN list_contains(r.seen, e.position) OR e.ms - r.ms > 21600000 THEN 1 ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.session_id = r.session_id AND e.i = r.i + 1
)
SELECT user_id AS client_id, session_id, render, min(ms) AS ts, CAST(count(*) AS INT) AS shown FROM r GROUP BY 1, 2, 3
"""


def asof_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the user's last view at or before them."""
    e = _events(spark, sf_dir)
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ms")
    viewed = e.filter("event_type = 'view'").groupBy("user_id", "ms").agg(F.max("event_id").alias("view_id"))
    return joins.asof(bought, viewed, "user_id", "ms", ["view_id"]).select("event_id", "user_id", F.col("asof_view_id").alias("view_id"))


ASOF_CREDIT = """
SELECT p.event_id, p.user_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND (epoch_us(p.ts) // 1000) >= (epoch_us(v.ts) // 1000)
"""


def prior_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user strictly before each event."""
    return joins.prior_counts(_events(spark, sf_dir), "user_id", F.col("ms"), F.col("event_type") == "click").select("event_id", "prior")


PRIOR_CLICKS = """
SELECT event_id, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM events
"""


def window_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user in the day after each purchase, and whether the window reads past a date."""
    e = _events(spark, sf_dir)
    q = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ms").alias("from_ms"), (F.col("ms") + 86_400_000).alias("to_ms"), F.lit(1_705_000_000_000).alias("as_of"))
    return joins.window_counts(q, e.filter("event_type = 'click'"), "user_id", "ms").select("event_id", "n", "violates")


WINDOW_CLICKS = """
SELECT p.event_id, count(c.event_id) AS n, (epoch_us(p.ts) // 1000) + 86400000 > 1705000000000 AS violates FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND (epoch_us(c.ts) // 1000) >= (epoch_us(p.ts) // 1000) AND (epoch_us(c.ts) // 1000) < (epoch_us(p.ts) // 1000) + 86400000 GROUP BY p.event_id, p.ts
"""


def ctr_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of high values by event type, with Wilson's interval."""
    out = telemetry.arm_table(_events(spark, sf_dir), ["event_type"], F.lit(True), F.col("value") > 50)
    return out.select("event_type", "impressions", "clicks", *[F.round(c, 9).alias(c) for c in ("ctr", "low", "high")])


CTR_WILSON = """
WITH g AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY 1), p AS (SELECT *, k / n AS p FROM g)
SELECT event_type, n AS impressions, k AS clicks, round(p, 9) AS ctr, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 9) AS low,
  round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 9) AS high FROM p
"""


def rank_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG, reciprocal rank and recall of orders' lines by price; returned lines are the relevant ones."""
    li = table(spark, sf_dir, "lineitem").withColumn("relevant", F.col("l_returnflag") == "R")
    r = ranking.ranked(li, ["l_orderkey"], F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    m = ranking.list_measures(r, ["l_orderkey"], 5)
    return m.select("l_orderkey", *[F.round(c, 9).alias(c) for c in ("ndcg", "mrr", "recall")])


RANK_MEASURES = """
WITH r AS (SELECT l_orderkey, l_returnflag = 'R' AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) - 1 AS rank FROM lineitem),
g AS (SELECT l_orderkey, count(*) FILTER (WHERE rel) AS n, sum(CASE WHEN rel AND rank < 5 THEN 1 / log2(rank + 2) ELSE 0 END) AS gain, min(rank) FILTER (WHERE rel) AS first, count(*) FILTER (WHERE rel AND rank < 5) AS hits FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN n > 0 THEN round(gain / list_sum(list_transform(range(least(n, 5)), lambda i: 1 / log2(i + 2))), 9) END AS ndcg, CASE WHEN n > 0 THEN round(1 / (first + 1), 9) END AS mrr, CASE WHEN n > 0 THEN round(hits / n, 9) END AS recall FROM g
"""


def organic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organic counts and whether they open the gate."""
    e = _events(spark, sf_dir)
    c = telemetry.organic_counts(e, F.col("user_id") % 3 > 0, F.col("event_type") == "view", "user_id", F.floor(F.col("ms") / 86_400_000))
    return telemetry.gate(c, {"impressions": 500, "interactions": 50, "clients": 25, "days": 7})


ORGANIC_GATE = """
WITH c AS (SELECT count(*) FILTER (WHERE o AND event_type = 'view') AS impressions, count(*) FILTER (WHERE o AND event_type <> 'view') AS interactions, count(DISTINCT CASE WHEN o THEN user_id END) AS clients,
  count(DISTINCT CASE WHEN o THEN (epoch_us(ts) // 1000) // 86400000 END) AS days, count(*) FILTER (WHERE NOT o) AS excluded FROM (SELECT *, user_id % 3 > 0 AS o FROM events))
SELECT *, impressions >= 500 AND interactions >= 50 AND clients >= 25 AND days >= 7 AS open FROM c
"""


def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", scoring.fnv1a(F.col("p_name")).alias("h"))


FNV_HASH = """
SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295) AS h FROM part
"""


def validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of events as telemetry, some rows spoiled: rows, bad ones and whether the batch is taken."""
    e = _events(spark, sf_dir)
    k = F.col("event_id")
    rows = e.select(
        (k / 40).cast("long").alias("batch"),
        F.when(k % 97 == 0, "scroll").otherwise("click").alias("type"),
        F.when(k % 101 == 0, F.lit(5).cast("long")).otherwise(F.col("ms")).alias("ts"),
        F.lpad(F.col("user_id").cast("string"), 16, "u").alias("client_id"),
        F.when(k % 103 == 0, "short").otherwise(F.lit("s" * 20)).alias("session_id"),
        F.col("event_type").alias("event_id"),
        (k % 1010).cast("int").alias("position"),
    )
    reason = telemetry.telemetry_reason(F.lit(1_800_000_000_000), {"type": ["impression", "click", "save"]})
    return telemetry.accept_batches(rows.withColumn("reason", reason), "batch", "reason")


VALIDATOR = """
WITH r AS (SELECT event_id // 40 AS batch, CASE WHEN event_id % 97 = 0 THEN 'type' WHEN event_id % 101 = 0 THEN 'ts' WHEN event_id % 103 = 0 THEN 'session_id' WHEN event_id % 1010 > 999 THEN 'position' END AS reason FROM events)
SELECT batch, count(*) AS n, count(reason) AS bad, count(*) <= 50 AND count(reason) = 0 AS accepted FROM r GROUP BY 1
"""


def draft_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaving outcome: lines of an order credit the team of their return flag."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("render"), F.when(F.col("l_returnflag") == "R", "candidate").otherwise("production").alias("team"))
    return telemetry.draft_outcomes(li).withColumn("delta", F.round("delta", 9))


DRAFT_CREDIT = """
WITH p AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS c, count(*) FILTER (WHERE l_returnflag <> 'R') AS p FROM lineitem GROUP BY 1)
SELECT count(*) AS renders, count(*) FILTER (WHERE c > p) AS wins, count(*) FILTER (WHERE c < p) AS losses, count(*) FILTER (WHERE c = p) AS ties, round(avg(sign(c - p)), 9) AS delta FROM p
"""


_IMUL = lambda a, b: f"(({a}) * (({b}) & 65535) + (((({a}) * (({b}) >> 16)) & 65535) << 16)) & 4294967295"
#: The generator's number, a share of 1, from its state t0; one step a level.
_DRAWN = lambda rows: f"""(SELECT *, (xor(t2, t2 >> 14) & 4294967295) / 4294967296.0::DOUBLE AS drawn_number FROM (
  SELECT *, xor(t1, (t1 + ({_IMUL('xor(t1, t1 >> 7)', 't1 | 61')})) & 4294967295) AS t2 FROM (SELECT *, {_IMUL('xor(t0, t0 >> 15)', 't0 | 1')} AS t1 FROM ({rows}))))"""  # noqa: E731


def team_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafted lists of orders: lines by number against lines by price."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"), F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_partkey"))).alias("b"))
    return ranking.team_drafts(li.select("key", F.col("a.l_partkey").alias("production"), F.col("b.l_partkey").alias("candidate")))


TEAM_DRAFTS = f"""
WITH RECURSIVE l AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS key, list(l_partkey ORDER BY l_linenumber, l_partkey) AS production, list(l_partkey ORDER BY l_extendedprice, l_partkey) AS candidate FROM lineitem GROUP BY 1
), s AS (
  SELECT *, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295) AS seed FROM l
), d AS (
  SELECT key, production, candidate, seed, 0 AS place, CAST([] AS BIGINT[]) AS taken, 0 AS p, 0 AS c, 0 AS drawn, CAST(NULL AS BIGINT) AS item, CAST(NULL AS VARCHAR) AS team FROM s
  UNION ALL
  SELECT key, production, candidate, seed, place + 1, list_append(taken, CASE team WHEN 'production' THEN a ELSE b END), p + (team = 'production')::INT, c + (team = 'candidate')::INT, drawn + even::INT,
    CASE team WHEN 'production' THEN a ELSE b END, team
  FROM (
    SELECT key, production, candidate, seed, place, taken, p, c, drawn, a, b, even, CASE WHEN b IS NULL OR (a IS NOT NULL AND (p < c OR (even AND drawn_number < 0.5))) THEN 'production' ELSE 'candidate' END AS team
    FROM {_DRAWN("""SELECT *, a IS NOT NULL AND b IS NOT NULL AND p = c AS even, (seed + CAST(drawn + 1 AS BIGINT) * 1831565813) & 4294967295 AS t0 FROM (
      SELECT key, production, candidate, seed, place, taken, p, c, drawn, list_filter(production, lambda x: NOT list_contains(taken, x))[1] AS a, list_filter(candidate, lambda x: NOT list_contains(taken, x))[1] AS b
      FROM d WHERE len(taken) < len(production))""")})
  WHERE a IS NOT NULL OR b IS NOT NULL
)
SELECT key, CAST(place - 1 AS INT) AS place, item, team FROM d WHERE place > 0
"""


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value with an interval by users drawn with replacement."""
    b = ranking.bootstrap_mean(_events(spark, sf_dir), "user_id", "value")
    return b.select(*[F.round(c, 7).alias(c) for c in ("mean", "low", "high")])


BOOTSTRAP = f"""
WITH p AS (SELECT user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(user_id AS VARCHAR)), 1, 3), user_id) - 1 AS k, count(*) OVER () AS total FROM p WHERE n > 0),
i AS (SELECT i, total, (4242 + ((i + 1) % 4294967296) * 1831565813) & 4294967295 AS t FROM (SELECT max(total) AS total FROM c) z, range(0, 2000 * z.total) r(i)),
o AS (SELECT i, total, {_IMUL('xor(t, t >> 15)', 't | 1')} AS t FROM i), w AS (SELECT i, total, xor(t, (t + ({_IMUL('xor(t, t >> 7)', 't | 61')})) & 4294967295) AS t FROM o),
d AS (SELECT i // total AS draw, CAST(floor((xor(t, t >> 14) & 4294967295) / 4294967296.0::DOUBLE * total) AS BIGINT) AS k FROM w),
v AS (SELECT draw, sum(s) / sum(n) AS v FROM d JOIN c USING (k) GROUP BY draw), q AS (SELECT list_sort(list(v)) AS vs FROM v)
SELECT round((SELECT sum(s) / sum(n) FROM c), 7) AS mean, round(vs[51], 7) AS low, round(vs[1951], 7) AS high FROM q
"""


def click_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a click model on events: value and hour of day against clicks."""
    e = _events(spark, sf_dir).select(F.array((F.floor(F.col("value") / 10) / 10).cast("double"), (F.hour("ts") / 24).cast("double")).alias("features"), (F.col("event_type") == "click").cast("double").alias("label"), scoring.position_weight(F.col("event_id") % 12).alias("weight"))
    m = ranking.fit_clicks(e)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate([*m.weights, m.bias])], "place int, weight double").withColumn("weight", F.round("weight", 6))


CLICK_MODEL = """
WITH RECURSIVE s AS (
  SELECT floor(value / 10) / 10 AS x0, hour(ts) / 24 AS x1, (event_type = 'click')::INT AS y, CAST(sum(least(10, event_id % 12 + 1)) AS DOUBLE) AS w FROM events GROUP BY 1, 2, 3
), t AS (SELECT sum(w) AS total FROM s), g AS (
  SELECT 0 AS step, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b
  UNION ALL
  SELECT step + 1, w0 - 0.5 * (sum(e * x0) / total + 0.01 * w0), w1 - 0.5 * (sum(e * x1) / total + 0.01 * w1), b - 0.5 * sum(e) / total
  FROM (SELECT g.*, x0, x1, total, w * (1 / (1 + exp(-(x0 * w0 + x1 * w1 + b))) - y) AS e FROM g, s, t WHERE step < 2000) GROUP BY step, w0, w1, b, total
), m AS (SELECT unnest([w0, w1, b]) AS weight, unnest([0, 1, 2]) AS place FROM g WHERE step = 2000)
SELECT CAST(place AS INT) AS place, round(weight, 6) AS weight FROM m
"""


def prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with enough rows before them."""
    return ranking.prequential_days(_events(spark, sf_dir), "ms", 200)


PREQUENTIAL = """
WITH d AS (SELECT (epoch_us(ts) // 1000) // 86400000 * 86400000 AS day_start, count(*) AS n FROM events GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY day_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM d)
SELECT day_start, n_before, n FROM b WHERE n_before >= 200
"""

QUERIES = {
    "session_gaps": (session_gaps, SESSION_GAPS),
    "renders": (renders, RENDERS),
    "asof_credit": (asof_credit, ASOF_CREDIT),
    "prior_clicks": (prior_clicks, PRIOR_CLICKS),
    "window_clicks": (window_clicks, WINDOW_CLICKS),
    "ctr_wilson": (ctr_wilson, CTR_WILSON),
    "rank_measures": (rank_measures, RANK_MEASURES),
    "organic_gate": (organic_gate, ORGANIC_GATE),
    "fnv_hash": (fnv_hash, FNV_HASH),
    "validator": (validator, VALIDATOR),
    "draft_credit": (draft_credit, DRAFT_CREDIT),
    "team_drafts": (team_drafts, TEAM_DRAFTS),
    "bootstrap": (bootstrap, BOOTSTRAP),
    "click_model": (click_model, CLICK_MODEL),
    "prequential": (prequential, PREQUENTIAL),
}
