"""Queries over evaluation: features, orderings, measures, credit, gates; and small merges of records.

A render is an order; what it shows are its parts, with what the lines and the part say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.operators import evaluate, publish, ranking
from brightquay.plans.board import NOW_MS, day_ms, table
from brightquay.plans.signals import _DRAWN

#: A fixed model: weights of the features, and the bias.
WEIGHTS, BIAS = tuple(round(0.3 - 0.05 * i, 2) for i in range(len(evaluate.FEATURES))), -0.2


def _line(moved: bool = False) -> dict[str, Column]:
    """Columns of a line; with ``moved``, everything that a feature must not read is changed."""
    line = {c: F.col(c) for c in ("l_shipdate", "l_quantity", "l_returnflag", "l_extendedprice", "l_discount")}
    if moved:
        line |= {"l_returnflag": F.when(line["l_returnflag"] == "R", "N").otherwise("R"), "l_extendedprice": line["l_extendedprice"] + 1234, "l_discount": 1 - line["l_discount"]}
    return line


def _seen(line: dict[str, Column], tag: str) -> list[Column]:
    """What the lines of a part in an order say, as ``at, relevant, prior, q`` with a tag."""
    said = {"at": F.min(line["l_shipdate"]), "relevant": F.bool_or(line["l_returnflag"] == "R"), "prior": F.count("*"), "q": F.sum(line["l_quantity"].cast("int")).cast("int")}
    return [c.alias(n + tag) for n, c in said.items()]


def _features(tag: str) -> Column:
    """The features of a part with what :func:`_seen` says."""
    size, prior, q = F.col("p_size"), F.col(f"prior{tag}"), F.col(f"q{tag}")
    row = {
        "confidence": size * 2, "builder_value": size + 50, "accessibility": F.when(F.col("p_type") == "ECONOMY", 40).otherwise(80), "freshness": prior * 30, "score": size,
        "category": F.when(F.col("p_type") == "PROMO", "adjacent").otherwise("hackathon"), "platform": F.when(size > 25, "luma").otherwise("external"), "start_ms": F.when(size % 10 > 0, day_ms(f"at{tag}")),
        "prize": F.when(F.col("p_type") == "STANDARD", "Not listed").when(size % 3 > 0, "$5 prizes").otherwise(""), "tags": F.array_repeat(F.lit("t"), size % 9), "region": F.when(size % 4 > 0, "bay"),
        "status": F.when(size % 2 > 0, "Open").otherwise("Closed"), "going": F.when(size % 5 > 0, q * 10),
    }
    return evaluate.features(F.lit(NOW_MS), F.lit("bay"), F.lit("south"), row)


def _of_parts(spark: SparkSession, sf_dir: str, *seen: Column) -> DataFrame:
    """``render, item``, what is seen of them, and their part."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("render"), F.col("l_partkey").alias("item")).agg(*seen)
    return li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_size", "p_type", "p_brand"), "item")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``render, item, ordinal, ts, start, prior, features, region, relevant``: each part that an order shows."""
    s = _of_parts(spark, sf_dir, *_seen(_line(), ""))
    return s.select("render", "item", F.col("item").alias("ordinal"), F.lit(NOW_MS).alias("ts"), F.date_format("at", "yyyy-MM-dd").alias("start"), "prior", _features("").alias("features"), F.col("p_brand").alias("region"), "relevant")


_UNIT = lambda x, most: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(CAST({x} AS DOUBLE), 0) / {most}))"
_F = ", ".join(
    f"{x} AS f{i}"
    for i, x in enumerate(
        [
            _UNIT("p_size * 2", 100), _UNIT("p_size + 50", 100), "CASE WHEN p_type = 'ECONOMY' THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END", _UNIT("prior * 30", 100), _UNIT("p_size", 100), "(p_type <> 'PROMO')::INT::DOUBLE", "(p_size > 25)::INT::DOUBLE",
            _UNIT(f"CASE WHEN p_size % 10 > 0 THEN (epoch_ms(shipped) - {NOW_MS}) / 86400000 END", 90), "(p_size % 10 = 0)::INT::DOUBLE", "(p_type <> 'STANDARD' AND p_size % 3 > 0)::INT::DOUBLE", _UNIT("p_size % 9", 6), "(p_size % 4 > 0)::INT::DOUBLE",
            "(p_size % 2 > 0)::INT::DOUBLE", _UNIT("CASE WHEN p_size % 5 > 0 THEN q * 10 END", 500), "(p_size % 5 = 0)::INT::DOUBLE",
        ]
    )
)
S = f"""l AS (SELECT l_orderkey AS render, l_partkey AS item, min(l_shipdate) AS shipped, bool_or(l_returnflag = 'R') AS relevant, count(*) AS prior, sum(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT render, item, strftime(shipped, '%Y-%m-%d') AS start, prior, relevant, p_brand AS region, {_F} FROM l JOIN part ON item = p_partkey)"""
_Z = " + ".join([f"{BIAS}::DOUBLE", *(f"f{i} * {w}::DOUBLE" for i, w in enumerate(WEIGHTS))])
O = f"""{S}, z AS (SELECT *, round({_Z}, 9) AS z, row_number() OVER (PARTITION BY render ORDER BY start, item) - 1 AS p FROM s),
o AS (SELECT render, 'production' AS ordering, item, p AS rank, region, relevant FROM z UNION ALL SELECT render, 'recency', item, p, region, relevant FROM z
  UNION ALL SELECT render, 'popularity', item, row_number() OVER (PARTITION BY render ORDER BY prior DESC, p) - 1, region, relevant FROM z UNION ALL SELECT render, 'candidate', item, row_number() OVER (PARTITION BY render ORDER BY z DESC, p) - 1, region, relevant FROM z)"""  # noqa: E741


def render_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen features of every item of every render."""
    return shown(spark, sf_dir).select("render", "item", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(len(evaluate.FEATURES))])


RENDER_FEATURES = f"WITH {S} SELECT render, item, {', '.join(f'f{i}' for i in range(len(evaluate.FEATURES)))} FROM s"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.orderings(shown(spark, sf_dir), WEIGHTS, BIAS)


def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under the four orderings that need no generator."""
    return _ordered(spark, sf_dir).filter("ordering <> 'random'").select("render", "ordering", "item", "rank")


ORDERED_LISTS = f"WITH {O} SELECT render, ordering, item, CAST(rank AS INT) AS rank FROM o"


def random_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under the seeded shuffle."""
    return _ordered(spark, sf_dir).filter("ordering = 'random'").select("render", "item", "rank")


RANDOM_LISTS = f"""
WITH RECURSIVE {S}, d AS (SELECT render, list(item ORDER BY item) AS a, count(*) - 1 AS i, 0 AS k FROM s GROUP BY 1), r AS (
  SELECT * FROM d
  UNION ALL
  SELECT render, list_transform(range(1, len(a) + 1), lambda x: CASE WHEN x = i + 1 THEN a[j + 1] WHEN x = j + 1 THEN a[i + 1] ELSE a[x] END), i - 1, k + 1
  FROM (SELECT render, a, i, k, CAST(floor(drawn_number * (i + 1)) AS BIGINT) AS j FROM {_DRAWN(f"SELECT *, ({(evaluate.RANDOM_SEED + NOW_MS) & 0xFFFFFFFF} + CAST(k + 1 AS BIGINT) * 1831565813) & 4294967295 AS t0 FROM r WHERE i > 0")})
)
SELECT render, unnest(a) AS item, CAST(generate_subscripts(a, 1) - 1 AS INT) AS rank FROM r WHERE i <= 0
"""


def ordering_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the measures by ordering, over the lists that have them."""
    m = ranking.list_measures(_ordered(spark, sf_dir).filter("ordering <> 'random'"), ["render", "ordering"], 5)
    means = [evaluate.mean_of(m, ["ordering"], c).select("ordering", F.lit(c).alias("measure"), F.round("mean", 9).alias("mean"), "scored") for c in ("ndcg", "mrr", "recall")]
    return means[0].unionByName(means[1]).unionByName(means[2])


ORDERING_MEASURES = f"""
WITH {O}, g AS (SELECT render, ordering, count(*) FILTER (WHERE relevant) AS n, sum(CASE WHEN relevant AND rank < 5 THEN 1 / log2(rank + 2) ELSE 0 END) AS gain, min(rank) FILTER (WHERE relevant) AS first, count(*) FILTER (WHERE relevant AND rank < 5) AS hits FROM o GROUP BY 1, 2),
m AS (SELECT ordering, CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(least(n, 5)), lambda i: 1 / log2(i + 2))) END AS ndcg, CASE WHEN n > 0 THEN 1 / (first + 1) END AS mrr, CASE WHEN n > 0 THEN hits / n END AS recall FROM g)
SELECT ordering, 'ndcg' AS measure, round(avg(ndcg), 9) AS mean, count(ndcg) AS scored FROM m GROUP BY 1 UNION ALL SELECT ordering, 'mrr', round(avg(mrr), 9), count(mrr) FROM m GROUP BY 1 UNION ALL SELECT ordering, 'recall', round(avg(recall), 9), count(recall) FROM m GROUP BY 1
"""


def ordering_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and brands among the first two places, by ordering."""
    return evaluate.coverage_by(_ordered(spark, sf_dir).filter("ordering <> 'random'"), 2)


ORDERING_COVERAGE = f"""
WITH {O} SELECT ordering, count(DISTINCT CASE WHEN rank < 2 THEN item END) AS coverage, round(count(DISTINCT CASE WHEN rank < 2 THEN item END) / count(DISTINCT item), 4) AS share, count(DISTINCT CASE WHEN rank < 2 THEN region END) AS regions FROM o GROUP BY 1
"""


def model_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted log-loss of the model on all items."""
    s = shown(spark, sf_dir).withColumn("label", F.col("relevant").cast("int"))
    p = 1 / (1 + F.exp(-evaluate.linear_score(F.col("features"), WEIGHTS, BIAS)))
    return evaluate.weighted_loss(s, "label", p, F.col("prior").cast("double")).select(F.round("loss", 9).alias("loss"))


MODEL_LOSS = f"WITH {S}, p AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS p FROM s) SELECT round(sum(prior * -CASE WHEN relevant THEN ln(p) ELSE ln(1 - p) END) / sum(prior), 9) AS loss FROM p"


def promotion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion gate over the offline measures."""
    o = _ordered(spark, sf_dir).filter("ordering <> 'random'")
    m = ranking.list_measures(o, ["render", "ordering"], 5).groupBy("ordering").agg(F.round(F.avg("ndcg"), 4).alias("ndcg"))
    offline = m.join(evaluate.coverage_by(o, 2), "ordering")
    organic = table(spark, sf_dir, "events").agg((F.count("*") > 500).alias("open"))
    return evaluate.promotion(offline, organic, F.lit(0.01), F.lit(False), F.lit(True))


PROMOTION_VERDICT = f"""
WITH {O}, g AS (SELECT render, ordering, count(*) FILTER (WHERE relevant) AS n, sum(CASE WHEN relevant AND rank < 5 THEN 1 / log2(rank + 2) ELSE 0 END) AS gain FROM o GROUP BY 1, 2),
m AS (SELECT ordering, round(avg(CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(least(n, 5)), lambda i: 1 / log2(i + 2))) END), 4) AS ndcg FROM g GROUP BY 1),
c AS (SELECT ordering, count(DISTINCT CASE WHEN rank < 2 THEN item END) AS coverage, count(DISTINCT CASE WHEN rank < 2 THEN region END) AS regions FROM o GROUP BY 1), j AS (SELECT * FROM m JOIN c USING (ordering)),
b AS (SELECT ordering, ndcg FROM j WHERE ordering <> 'candidate' ORDER BY ndcg DESC, CASE ordering WHEN 'production' THEN 0 WHEN 'popularity' THEN 1 ELSE 2 END LIMIT 1),
v AS (SELECT true AS no_leakage, true AS controls_behaved, (SELECT ndcg FROM j WHERE ordering = 'candidate') > b.ndcg AS beats_baseline, b.ordering AS best_baseline, true AS wins_organic,
  1 - (SELECT coverage FROM j WHERE ordering = 'candidate') / (SELECT coverage FROM j WHERE ordering = 'production') <= 0.1 AND (SELECT regions FROM j WHERE ordering = 'candidate') >= (SELECT regions FROM j WHERE ordering = 'production') AS diversity_held, (SELECT count(*) > 500 FROM events) AS gate_met FROM b)
SELECT *, CASE WHEN NOT gate_met THEN 'Implemented result pending' WHEN beats_baseline AND diversity_held THEN 'Promote' ELSE 'Do not promote' END AS verdict FROM v
"""


def leak_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose features move under a forbidden change, and under one that a planted leak reads."""
    s = _of_parts(spark, sf_dir, *_seen(_line(), "0"), *_seen(_line(moved=True), "1"))  # both out of the same lines at once, so vectors are not joined
    leaky = lambda tag: F.concat(F.col(f"own{tag}"), F.array(F.col(f"relevant{tag}").cast("double")))
    s = s.select(_features("0").alias("own0"), _features("1").alias("own1"), "relevant0", "relevant1").select("own0", "own1", leaky("0").alias("leaky0"), leaky("1").alias("leaky1"))
    return s.agg(F.count_if(evaluate.reads_future(F.col("own0"), F.col("own1"))).alias("moved"), F.count_if(evaluate.reads_future(F.col("leaky0"), F.col("leaky1"))).alias("planted"), F.count("*").alias("n"))


LEAK_CONTROLS = """
WITH l AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1, 2)
SELECT CAST(0 AS BIGINT) AS moved, count(*) FILTER (WHERE a <> b) AS planted, count(*) AS n FROM l JOIN part ON l_partkey = p_partkey
"""


def control_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative controls by order status: which behaved."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ("leak", "shuffle", "cold", "missing"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("control"), (F.col("o_custkey") % 2 == 0).alias("detected"), (F.col("o_custkey") % 3 == 0).alias("planted"), (F.col("o_totalprice") / 100000).alias("value"), F.lit(2.5).alias("bound"), (F.col("o_orderstatus") != "P").alias("same"))
    return evaluate.control_outcomes(o).groupBy("control").agg(F.count_if("behaved").alias("behaved"), F.count("*").alias("n"))


CONTROL_OUTCOMES = """
WITH c AS (SELECT ['leak', 'shuffle', 'cold', 'missing'][o_orderkey % 4 + 1] AS control, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 2 = 0) = (o_custkey % 3 = 0) WHEN 1 THEN o_totalprice / 100000 <= 2.5 ELSE o_orderstatus <> 'P' END AS b FROM orders)
SELECT control, count(*) FILTER (WHERE b) AS behaved, count(*) AS n FROM c GROUP BY 1
"""


def click_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source, first interactions, team credit and training window, in one table of counts."""
    e = table(spark, sf_dir, "events").withColumn("ms", day_ms("ts"))
    source = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("source").alias("what"), "name", "n")
    rows = e.select(F.col("user_id").alias("render"), F.col("event_type").alias("event"), F.col("ms").alias("ts"))
    first = evaluate.first_interactions(rows).select(F.lit("first").alias("what"), F.concat_ws("/", F.col("render").cast("string"), "event").alias("name"), F.col("first_ms").alias("n"))
    items = rows.select("render", "event").distinct().withColumn("team", F.when((F.col("render") + F.length("event")) % 2 == 0, "candidate").otherwise("production")).filter("event <> 'view'")
    credit = evaluate.team_credit(rows, items).groupBy("team").agg(F.count("*").alias("n")).select(F.lit("credit").alias("what"), F.col("team").alias("name"), "n")
    w = evaluate.training_window(e.withColumn("label", (F.col("event_type") == "click").cast("int")), "ms", "label")
    window = w.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in w.columns])).alias("x")).select(F.lit("window").alias("what"), "x.name", "x.n")
    seen = evaluate.catalogued(rows.select(F.col("event")), items.select("event").distinct(), "event").groupBy("event").agg(F.count("*").alias("n")).select(F.lit("catalogued").alias("what"), F.col("event").alias("name"), "n")
    return source.unionByName(first).unionByName(credit).unionByName(window).unionByName(seen)


CLICK_TEAMS = """
WITH r AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS ms FROM events), d AS (SELECT DISTINCT user_id, event_type FROM r WHERE event_type <> 'view')
SELECT 'source' AS what, event_type AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'first', user_id || '/' || event_type, min(ms) FROM r GROUP BY user_id, event_type
UNION ALL SELECT 'credit', CASE WHEN (user_id + length(event_type)) % 2 = 0 THEN 'candidate' ELSE 'production' END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'window', 'first_ms', min(ms) FROM r UNION ALL SELECT 'window', 'last_ms', max(ms) FROM r UNION ALL SELECT 'window', 'n', count(*) FROM r UNION ALL SELECT 'window', 'positives', count(*) FILTER (WHERE event_type = 'click') FROM r UNION ALL SELECT 'window', 'days', count(DISTINCT ms // 86400000) FROM r
UNION ALL SELECT 'catalogued', event_type, count(*) FROM r WHERE event_type <> 'view' GROUP BY 2
"""


def list_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How lists are ranked, whether two orderings agree, and each list's hash."""
    o = _ordered(spark, sf_dir)
    p, c = o.filter("ordering = 'production'"), o.filter("ordering = 'popularity'")
    same = evaluate.same_order(p, c, "render", "rank", "item")
    mode = evaluate.rank_mode(F.when(F.col("render") % 3 > 0, F.col("render")), True)
    return same.join(evaluate.order_hash(p, "render", "rank", "item"), "render").select("render", "agrees", "sha256", mode.alias("mode"))


LIST_AGREEMENT = f"""
WITH {O}, li AS (SELECT render, ordering, list(item ORDER BY rank) AS xs FROM o GROUP BY 1, 2), p AS (SELECT * FROM li WHERE ordering = 'production'), c AS (SELECT * FROM li WHERE ordering = 'popularity')
SELECT render, p.xs = c.xs AS agrees, sha256('[' || array_to_string(p.xs, ',') || ']') AS sha256, CASE WHEN render % 3 > 0 THEN 'interleaved' ELSE 'production' END AS mode FROM p JOIN c USING (render)
"""


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest, first, and contextual records per key: three merges of order rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("context"))
    high = publish.keep_highest(o, "o_custkey", "o_totalprice", "o_orderkey").select(F.lit("highest").alias("rule"), F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    first = publish.first_of(o, ["o_custkey", "o_orderstatus"], "o_orderkey").select(F.lit("first").alias("rule"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus").alias("key"), "o_orderkey")
    ctx = publish.with_context_first(o, "o_custkey", "context", "o_orderkey").select(F.lit("context").alias("rule"), F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    return high.unionByName(first).unionByName(ctx)


MERGED_RECORDS = """
SELECT 'highest' AS rule, CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey UNION ALL SELECT 'first', o_custkey || '/' || o_orderstatus, min(o_orderkey) FROM orders GROUP BY o_custkey, o_orderstatus
UNION ALL SELECT 'context', CAST(o_custkey AS VARCHAR), coalesce(min(CASE WHEN o_orderpriority < '3' THEN o_orderkey END), max(o_orderkey)) FROM orders GROUP BY o_custkey
"""


def feed_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts of each month against the month before: which numbers stand, and fresher facts by customer segment."""
    o = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(F.count("*").alias("now"))
    before = o.select((F.col("month") + 1).alias("month"), F.col("now").alias("previous"))
    return publish.feed_collapsed(o.join(before, "month").select("month", "previous", "now"), floor=150)


FEED_FALLBACKS = """
WITH o AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month, count(*) AS now FROM orders GROUP BY 1), j AS (SELECT o.month, b.now AS previous, o.now FROM o JOIN o b ON o.month = b.month + 1)
SELECT *, previous > 0 AND now < greatest(150, ceil(previous * 0.5)) AS collapsed, CASE WHEN previous > 0 AND now < greatest(150, ceil(previous * 0.5)) THEN previous ELSE now END AS stands FROM j
"""


def fresh_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of facts per customer, the newer one's values winning."""
    c = table(spark, sf_dir, "customer")
    older, newer = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")), F.create_map(F.lit("nation"), F.lit("new"), F.lit("name"), F.col("c_name"))
    m = publish.fresher_maps(older, newer)
    return c.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("facts"))


FRESH_FACTS = "SELECT c_custkey, 'name=' || c_name || ',nation=new,segment=' || c_mktsegment AS facts FROM customer"


def drifted_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as board entries whose calendar entry, by name or by its beginning, starts at another time."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.col("p_name"), F.lit(" no. "), F.col("p_partkey").cast("string"), F.lit("!"))
    board = p.select(F.col("p_partkey").alias("id"), F.concat(name, F.when(F.col("p_size") % 2 == 0, " by night").otherwise("")).alias("title"), F.when(F.col("p_size") % 11 > 0, F.col("p_size") * 60_000).alias("start_ms"))
    calendar = p.select(F.col("p_partkey").alias("ordinal"), name.alias("title"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 60_000).otherwise(F.col("p_size") * 60_000 + F.col("p_partkey") % 5 * 30_000).alias("start_ms"))
    return publish.drifted(board, calendar)


DRIFTED_STARTS = """
WITH p AS (SELECT *, regexp_replace(p_name || 'no' || p_partkey, '[^A-Za-z0-9]', '', 'g') AS k, p_size * 60000 AS s, CASE WHEN p_size % 3 = 0 THEN p_size * 60000 ELSE p_size * 60000 + p_partkey % 5 * 30000 END AS c FROM part),
b AS (SELECT p_partkey AS id, lower(k || CASE WHEN p_size % 2 = 0 THEN 'bynight' ELSE '' END) AS own, s FROM p WHERE p_size % 11 > 0), e AS (SELECT lower(k) AS k, c, p_partkey FROM p),
m AS (SELECT id, s, c, row_number() OVER (PARTITION BY id ORDER BY own = k DESC, length(k) DESC, k DESC) AS i FROM b JOIN e ON own = k OR (length(own) >= 12 AND length(k) >= 12 AND (starts_with(own, k) OR starts_with(k, own))))
SELECT id, s AS board_ms, c AS calendar_ms FROM m WHERE i = 1 AND abs(c - s) >= 60000
"""


def seed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seed passes: what their last run calls for."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("label"), F.when(k % 10 > 0, F.lit(NOW_MS) - k * 600_000).alias("collected_ms"), (k % 4).alias("queries"), (k % 6).alias("problems"), F.when(k % 7 == 0, 1).otherwise(0).alias("misconfigured"), (k % 5).alias("tracked"))
    return publish.seed_review(s, F.lit(NOW_MS))


SEED_REVIEWS = """
WITH s AS (SELECT s_name AS label, s_suppkey AS k, s_suppkey % 10 = 0 OR s_suppkey * 600000 < 7200000 AS ran FROM supplier)
SELECT label, 'failure' AS severity, 'misconfigured' AS message FROM s WHERE ran AND k % 7 = 0 UNION ALL SELECT label, 'warning', CASE WHEN k % 4 > 0 AND k % 6 >= k % 4 THEN 'all queries failed' ELSE 'no seeds' END FROM s WHERE ran AND k % 7 > 0 AND ((k % 4 > 0 AND k % 6 >= k % 4) OR k % 5 = 0)
UNION ALL SELECT label, 'note', CASE WHEN ran THEN 'ran' ELSE 'not run' END FROM s
"""


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty orders, ties by key: the table query, a top-k report."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


LATEST_ROWS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"

QUERIES = {
    "render_features": (render_features, RENDER_FEATURES),
    "ordered_lists": (ordered_lists, ORDERED_LISTS),
    "random_lists": (random_lists, RANDOM_LISTS),
    "ordering_measures": (ordering_measures, ORDERING_MEASURES),
    "ordering_coverage": (ordering_coverage, ORDERING_COVERAGE),
    "model_loss": (model_loss, MODEL_LOSS),
    "promotion_verdict": (promotion_verdict, PROMOTION_VERDICT),
    "leak_controls": (leak_controls, LEAK_CONTROLS),
    "control_outcomes": (control_outcomes, CONTROL_OUTCOMES),
    "click_teams": (click_teams, CLICK_TEAMS),
    "list_agreement": (list_agreement, LIST_AGREEMENT),
    "merged_records": (merged_records, MERGED_RECORDS),
    "feed_fallbacks": (feed_fallbacks, FEED_FALLBACKS),
    "fresh_facts": (fresh_facts, FRESH_FACTS),
    "drifted_starts": (drifted_starts, DRIFTED_STARTS),
    "seed_reviews": (seed_reviews, SEED_REVIEWS),
    "latest_rows": (latest_rows, LATEST_ROWS),
}
