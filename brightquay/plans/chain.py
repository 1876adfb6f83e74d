"""The chain from the log to a verdict: renders, features, a model per day, orderings, measures, drafts, controls, gates.

Events are the log. A user's events of a day are cut into renders; what an event shows is
the part that its properties name, and a click or purchase is an interaction. Parts are the
catalog that features read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.functions import scoring
from brightquay.operators import descent, evaluate, joins, ranking, telemetry
from brightquay.plans.board import day_ms, table

DAY_MS = 86_400_000
#: Rows that a day needs before it, and places that measures look at.
LEAST_ROWS, PLACES = 200, 5
#: Fields of the catalog that a feature may read; all others are forbidden.
ALLOWED = ("p_partkey", "p_brand", "p_type", "p_size")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ms, client, day, item, label`` of all events."""
    e = table(spark, sf_dir, "events").withColumn("ms", day_ms("ts"))
    item = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ms", F.col("user_id").alias("client"), F.floor(F.col("ms") / DAY_MS).alias("day"), item.alias("item"), F.col("event_type").isin("click", "purchase").alias("label"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts."""
    return table(spark, sf_dir, "part")


def extracted(as_of: Column) -> Column:
    """The fifteen features of a part at an instant, and of nothing but what is ALLOWED and the clicks before it."""
    size = F.col("p_size")
    row = {
        "confidence": size * 2, "builder_value": size + 50, "accessibility": F.when(F.col("p_type") == "ECONOMY", 40).otherwise(80), "freshness": 100 - size, "score": F.col("p_partkey") % 100,
        "category": F.when(F.col("p_type") == "PROMO", "adjacent").otherwise("hackathon"), "platform": F.when(size > 25, "luma").otherwise("external"), "start_ms": F.when(size % 10 > 0, F.lit(1_704_067_200_000) + size.cast("long") * DAY_MS),
        "prize": F.when(F.col("p_type") == "STANDARD", "Not listed").when(size % 3 > 0, "$5 prizes").otherwise(""), "tags": F.array_repeat(F.lit("t"), size % 9), "region": F.when(size % 4 > 0, "bay"),
        "status": F.when(size % 2 > 0, "Open").otherwise("Closed"), "going": F.when(size % 5 > 0, F.col("p_partkey") % 600),
    }
    return evaluate.features(as_of, F.lit("bay"), F.lit("south"), row)


def shown_parts(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """``render, client, day, ts, ms, event_id, item, ordinal, start, prior, features, region, relevant, weight``: a row per item of a render."""
    e = log(spark, sf_dir)
    cut = telemetry.renders(e.select(F.col("client").alias("client_id"), F.col("day").alias("session_id"), F.col("ms").alias("ts"), F.col("item").alias("position"), "event_id"), gap_ms=6 * 3_600_000)
    items = cut.select(F.concat_ws("/", "client_id", "session_id", "render").alias("render"), "ts", F.explode("items").alias("i")).select("render", "ts", F.col("i.event_id").cast("long").alias("event_id"))
    counted = joins.prior_counts(e, "item", F.col("ms"), F.col("label"))
    rows = items.join(counted, "event_id").join(parts if parts is not None else catalog(spark, sf_dir), F.col("item") == F.col("p_partkey"))
    place = F.row_number().over(ranking.W.partitionBy("render").orderBy("ms", "event_id")) - 1
    start = F.when(F.col("p_size") % 10 > 0, F.lpad(F.col("p_size").cast("string"), 4, "0"))
    rows = rows.withColumn("ordinal", place).withColumn("features", extracted(F.col("ms"))).withColumn("start", start)
    return rows.select("render", "client", "day", "ts", "ms", "event_id", "item", "ordinal", "start", "prior", "features", F.col("p_brand").alias("region"), F.col("label").alias("relevant"), F.col("label").cast("double").alias("label"), scoring.position_weight(F.col("ordinal")).alias("weight"))


def models(shown: DataFrame, shuffled: bool = False) -> DataFrame:
    """A model per day on the labels, and with ``shuffled`` one on labels that were shuffled. The days until a start are the one feature that time moves."""
    rows, labels = (evaluate.shuffled_labels(shown, "event_id", "label"), ("label", "shuffled")) if shuffled else (shown, ("label",))
    return descent.fit_days(rows, "day", labels=labels, least=LEAST_ROWS, dense=evaluate.FEATURES.index("daysUntilStart"))


def daily_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of every day's model."""
    m = models(shown_parts(spark, sf_dir).persist())
    return m.select("day", "n_before", F.posexplode(F.concat("weights", F.array("bias"))).alias("place", "weight")).withColumn("weight", F.round("weight", 6))


def _judged(shown: DataFrame, m: DataFrame, label: str = "label") -> DataFrame:
    """Orderings of the renders of days that have a model."""
    scored = evaluate.scored_by_day(shown, m, "day", label, "z").filter("z IS NOT NULL")
    return evaluate.orderings_by(scored, F.col("z"))


def _means(ordered: DataFrame) -> DataFrame:
    m, names = ranking.list_measures(ordered, ["render", "ordering"], PLACES), ("ndcg", "mrr", "recall")
    g = m.groupBy("ordering").agg(*[F.struct(F.lit(c).alias("measure"), F.round(F.avg(c), 6).alias("mean"), F.count(c).alias("scored")).alias(c) for c in names])
    return g.select("ordering", F.explode(F.array(*names)).alias("m")).select("ordering", "m.*")


def daily_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all five orderings, each render under the model of the days before it."""
    shown = shown_parts(spark, sf_dir).persist()
    return _means(_judged(shown, models(shown)))


def _drafted(ordered: DataFrame, shown: DataFrame) -> DataFrame:
    """Outcomes of lists drafted from the production and candidate orderings."""
    lists = ordered.filter("ordering IN ('production', 'candidate')").groupBy("render", "ordering").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
    both = lists.groupBy(F.col("render").alias("key")).agg(F.max(F.when(F.col("ordering") == "production", F.col("items"))).alias("production"), F.max(F.when(F.col("ordering") == "candidate", F.col("items"))).alias("candidate"))
    drafts = ranking.team_drafts(both).withColumnRenamed("key", "render")
    clicked = shown.filter("relevant").select("render", "item").distinct()
    return evaluate.clustered_outcomes(drafts, clicked, shown.select("render", "client").distinct())


def _summary(outcomes: DataFrame) -> DataFrame:
    counts = outcomes.agg(F.count("*").alias("renders"), F.countDistinct("client").alias("clients"), *[F.count_if(F.col("value") == v).alias(n) for v, n in ((1, "wins"), (-1, "losses"), (0, "ties"))])
    b = ranking.bootstrap_mean(outcomes, "client", "value")
    return counts.join(F.broadcast(b)).select("renders", "clients", "wins", "losses", "ties", F.round("mean", 6).alias("delta"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))  # one row each


def interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts from the day models' lists: wins, losses, ties and the mean outcome with its interval by client."""
    shown = shown_parts(spark, sf_dir).persist()
    return _summary(_drafted(_judged(shown, models(shown)), shown).persist())


def perturbed(parts: DataFrame) -> DataFrame:
    """Parts with every field that features may not read moved, and with fields of what came after."""
    def other(name: str, kind: str) -> Column:
        return F.concat(F.col(name), F.lit("-moved")) if kind == "string" else F.col(name) + 1234
    return parts.select(*[F.col(n) if n in ALLOWED else other(n, k).alias(n) for n, k in parts.dtypes], F.lit(991).alias("future_clicks"), F.lit(137).alias("clicks_after"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: future reads and moved features of the extractor, and of one that is made to leak."""
    parts = catalog(spark, sf_dir)
    own, after = shown_parts(spark, sf_dir, parts), shown_parts(spark, sf_dir, perturbed(parts))
    clicks = log(spark, sf_dir).filter("label").select("item", "ms")

    def asked(first: Column, last: Column) -> DataFrame:
        """Windows of clicks that an extractor asks for at each item's instant, and whether they reach beyond it."""
        return joins.window_counts(own.select("event_id", "item", first.alias("from_ms"), last.alias("to_ms"), F.col("ms").alias("as_of")), clicks, "item", "ms")

    moved = ranking.moved_features(own.select("event_id", "features"), after.select("event_id", "features"), "event_id").agg(F.count("*").alias("moved"))
    # the planted extractor also reads a price and the clicks of the week that follows
    price = lambda p: F.col("p_retailprice").alias(p)
    leaky = own.join(parts.select("p_partkey", price("a")), F.col("item") == F.col("p_partkey")).join(perturbed(parts).select(F.col("p_partkey").alias("_k"), price("b")), F.col("item") == F.col("_k"))
    planted = leaky.agg(F.count_if(evaluate.reads_future(F.concat("features", F.array("a")), F.concat("features", F.array("b")))).alias("planted_moved"))
    at = F.col("ms")
    future = asked(F.lit(0).cast("long"), at).agg(F.count_if("violates").alias("future_reads"))
    reads = asked(at, at + 7 * DAY_MS).agg(F.count_if("violates").alias("planted_reads"), F.sum("n").alias("peeked"))
    return reduce(lambda x, y: x.join(F.broadcast(y)), [future, moved, reads, planted]).select("future_reads", "moved", "planted_reads", "planted_moved", "peeked")  # one row each


LEAKS = """
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, event_type IN ('click', 'purchase') AS label, user_id AS client FROM events),
s AS (SELECT e.*, p.p_retailprice FROM e JOIN part p ON item = p_partkey)
SELECT CAST(0 AS BIGINT) AS future_reads, CAST(0 AS BIGINT) AS moved, count(*) AS planted_reads, count(*) FILTER (WHERE p_retailprice IS DISTINCT FROM p_retailprice + 1234) AS planted_moved,
  (SELECT count(*) FROM s a JOIN e c ON c.label AND c.item = a.item AND c.ms >= a.ms AND c.ms < a.ms + 604800000) AS peeked FROM s
"""


def _controls(shown: DataFrame, m: DataFrame, leak: DataFrame, ordered: DataFrame) -> DataFrame:
    """``control, value, bound, behaved`` of the four negative controls; ``ordered`` are the orderings under the models of the labels."""
    blind = _judged(shown, m, "shuffled")
    ndcg = lambda o, name, as_: ranking.list_measures(o.filter(F.col("ordering") == name), ["render"], PLACES).agg(F.round(F.avg("ndcg"), 6).alias(as_))
    shuffle = ndcg(blind, "candidate", "value").join(F.broadcast(ndcg(ordered, "popularity", "bound"))).select(F.lit("shuffle").alias("control"), "value", "bound", (F.col("value") <= F.col("bound")).alias("behaved"))
    leak_row = leak.select(F.lit("leak").alias("control"), F.col("planted_moved").cast("double").alias("value"), F.col("moved").cast("double").alias("bound"), ((F.col("planted_moved") > 0) & (F.col("moved") == 0)).alias("behaved"))
    # without a client, and on days without a model, the served list is the production list itself
    served = served_lists_of(shown, m)
    plain = served.groupBy(F.col("why").alias("control")).agg(F.avg(F.col("same").cast("double")).alias("value"), F.lit(1.0).alias("bound")).filter("control IN ('cold', 'missing')").withColumn("behaved", F.col("value") == 1)
    return leak_row.unionByName(shuffle).unionByName(plain)


def served_lists_of(shown: DataFrame, m: DataFrame) -> DataFrame:
    """``render, why, mode, same``: how each render is ranked, and whether the list is the production list.

    A client below ten stands for one without consent. With a client and a model the list is drafted from both
    orderings, else it is the production list: cold without a client, missing without a model.
    """
    scored = evaluate.scored_by_day(shown, m, "day", "label", "z")
    state = scored.groupBy("render").agg(F.when(F.first("client") >= 10, F.first("client")).alias("known"), F.bool_and(F.col("z").isNotNull()).alias("modelled"))
    why = F.when(F.col("known").isNull(), "cold").when(~F.col("modelled"), "missing").otherwise("drafted")
    mode = F.when(F.col("modelled"), evaluate.rank_mode(F.col("known"), True)).otherwise(evaluate.rank_mode(F.col("known"), False))
    state = state.select("render", why.alias("why"), mode.alias("mode"))
    o = evaluate.orderings_by(scored.withColumn("z", F.coalesce("z", F.lit(0.0))), F.col("z")).filter("ordering IN ('production', 'candidate')")
    lists = o.groupBy("render").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("ordering") == n, F.struct("rank", "item")))), lambda x: x["item"]).alias(n) for n in ("production", "candidate")])
    drafted = ranking.team_drafts(lists.join(state.filter("mode = 'interleaved'"), "render").select(F.col("render").alias("key"), "production", "candidate")).groupBy(F.col("key").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("drafted"))
    served = state.join(lists, "render").join(drafted, F.col("render") == F.col("_r"), "left")
    return served.select("render", "why", "mode", F.coalesce("drafted", "production").eqNullSafe(F.col("production")).alias("same"))


def served_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every render is ranked, and whether it differs from the production list."""
    shown = shown_parts(spark, sf_dir).persist()
    return served_lists_of(shown, models(shown)).groupBy("why", "mode").agg(F.count("*").alias("renders"), F.count_if("same").alias("same"))


def trained_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative controls: a planted leak is seen, a model of shuffled labels doesn't win, and the cold and missing lists are frozen."""
    shown = shown_parts(spark, sf_dir).persist()
    m = models(shown, shuffled=True)
    return _controls(shown, m, leaks(spark, sf_dir), _judged(shown, m))


def chain_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion gate over what the whole chain finds: measures, coverage, drafts, leaks, controls, organic counts."""
    shown = shown_parts(spark, sf_dir).persist()
    m, leak = models(shown, shuffled=True), leaks(spark, sf_dir).persist()
    ordered = _judged(shown, m).persist()
    offline = _means(ordered).filter("measure = 'ndcg'").select("ordering", F.col("mean").alias("ndcg")).join(evaluate.coverage_by(ordered, PLACES), "ordering")
    e = log(spark, sf_dir)
    counts = telemetry.organic_counts(e, F.col("client") >= 10, ~F.col("label"), "client", F.col("day"))
    organic = telemetry.gate(counts, {"impressions": 500, "interactions": 50, "clients": 25, "days": 7})
    delta = _summary(_drafted(ordered, shown).persist()).first()  # one row, as the next two
    seen, behaved = leak.select((F.col("moved") + F.col("future_reads") > 0).alias("x")).first().x, _controls(shown, m, leak, ordered).agg(F.bool_and("behaved").alias("x")).first().x
    return evaluate.promotion(offline, organic, F.lit(delta.low).cast("double"), F.lit(bool(seen)), F.lit(bool(behaved)))


QUERIES = {
    "daily_weights": (daily_weights, None),
    "daily_measures": (daily_measures, None),
    "interleaving": (interleaving, None),
    "served_lists": (served_lists, None),
    "trained_controls": (trained_controls, None),
    "chain_verdict": (chain_verdict, None),
    "leaks": (leaks, LEAKS),
}
