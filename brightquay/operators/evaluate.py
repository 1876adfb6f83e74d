"""Evaluation of orderings: features, baselines, measures by ordering, credit, gates and verdicts."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightquay.functions.scoring import linear_score, log_loss
from brightquay.operators.gates import first_true
from brightquay.operators.ranking import numbered_keys, shuffled

# The features in order, and where counts saturate.
FEATURES = ("confidence", "builderValue", "accessibility", "freshness", "score", "isHackathon", "isLuma", "daysUntilStart", "daysUntilStartMissing", "hasPrize", "tagCount", "regionMatch", "statusOpen", "going", "goingMissing")
DAYS, GOING, TAGS = 90, 500, 6
#: Seed of the random baseline; a list's time is added.
RANDOM_SEED = 20260909
ORDERINGS = ("production", "popularity", "recency", "random", "candidate")


def unit(value: Column, most: float) -> Column:
    """``value`` over ``most``, within 0 and 1; nothing is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0)) / most))


def features(as_of_ms: Column, region: Column, default_region: Column, row: Mapping[str, Column] | None = None) -> Column:
    """The vector of a record at a render: ``confidence, builder_value, accessibility, freshness, score, category, platform, start_ms, prize, tags, region, status, going``.

    It reads what a sweep wrote and the render's own instant, never what came after.
    """
    c = lambda name: (row or {}).get(name, F.col(name))
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    days = (c("start_ms") - as_of_ms) / 86_400_000
    return F.array(
        *[unit(c(n), 100) for n in ("confidence", "builder_value", "accessibility", "freshness", "score")],
        flag(c("category") == "hackathon"),
        flag(c("platform") == "luma"),
        unit(days, DAYS),
        c("start_ms").isNull().cast("double"),
        flag((c("prize") != "") & (c("prize") != "Not listed")),
        unit(F.size(F.coalesce(c("tags"), F.array().cast("array<string>"))), TAGS),
        flag(F.coalesce(c("region"), default_region) == region),
        flag(c("status") == "Open"),
        unit(c("going"), GOING),
        c("going").isNull().cast("double"),
    )


def production_rank(by: Sequence[str], start: str, ordinal: str) -> Column:
    """Place from 0 by start, none last, ties in input order."""
    return F.row_number().over(W.partitionBy(*by).orderBy(F.coalesce(F.col(start), F.lit("9999")), ordinal)) - 1


def shuffled_ranks(lists: DataFrame, key: str, seed: str, items: str) -> DataFrame:
    """``key, item, rank`` of lists in a seeded random order; lists are short, a row each."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, x, i) for k, s, xs in zip(f[key], f[seed], f[items], strict=True) for i, x in enumerate(shuffled(xs, int(s)))]
            yield pd.DataFrame(rows, columns=[key, "item", "rank"])

    kind = lists.schema[items].dataType.elementType.simpleString()
    return lists.select(key, seed, items).mapInPandas(of, f"{key} {lists.schema[key].dataType.simpleString()}, item {kind}, rank int")


def orderings(shown: DataFrame, weights: Sequence[float], bias: float) -> DataFrame:
    """:func:`orderings_by` the score of one model."""
    return orderings_by(shown, linear_score(F.col("features"), weights, bias))


def orderings_by(shown: DataFrame, score: Column) -> DataFrame:
    """``render, ordering, item, rank, region, relevant`` of ``render, ts, item, ordinal, start, prior, features, region, relevant`` rows.

    production and recency go by start, popularity by prior clicks, candidate by ``score``;
    ties follow the production order. random shuffles the list as it was shown.
    """
    s = shown.withColumn("_z", F.round(score, 9)).drop("features")  # equal but for rounding is a tie; the vectors are not sorted along
    s = s.withColumn("_p", production_rank(["render"], "start", "ordinal"))
    place = lambda *keys: (F.row_number().over(W.partitionBy("render").orderBy(*keys)) - 1).cast("int")
    s = s.withColumn("_popularity", place(F.desc("prior"), "_p")).withColumn("_recency", place(F.coalesce(F.col("start"), F.lit("9999")), "ordinal")).withColumn("_candidate", place(F.desc("_z"), "_p"))
    ranks = F.array(*[F.struct(F.lit(n).alias("ordering"), F.col(c).cast("int").alias("rank")) for n, c in (("production", "_p"), ("popularity", "_popularity"), ("recency", "_recency"), ("candidate", "_candidate"))])
    fixed = s.withColumn("_r", F.explode(ranks)).select("render", "_r.ordering", "item", "_r.rank", "region", "relevant")
    lists = shown.groupBy("render").agg((F.first("ts") + RANDOM_SEED).alias("seed"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item"))), lambda x: x["item"]).alias("items"))
    drawn = shuffled_ranks(lists, "render", "seed", "items").withColumn("ordering", F.lit("random"))
    return fixed.unionByName(drawn.join(shown.select("render", "item", "region", "relevant"), ["render", "item"]).select(*fixed.columns))


def coverage_by(ranked: DataFrame, k: int = 10) -> DataFrame:
    """``ordering, coverage, share, regions``: distinct items and regions within the first ``k`` places, and the share of all items shown."""
    # items, regions of the first places and orderings are each made distinct before they are counted
    top, who = F.col("rank") < k, [F.struct(F.lit(0).alias("kind"), F.col("item").cast("string").alias("name")), F.struct(F.lit(1).alias("kind"), F.when(F.col("rank") < k, F.col("region").cast("string")).alias("name"))]
    each = ranked.select("ordering", top.alias("_top"), F.explode(F.array(*who)).alias("_w")).groupBy("ordering", "_w.kind", "_w.name").agg(F.max("_top").alias("_top"))
    counted = lambda kind, *more: F.count_if((F.col("kind") == kind) & F.col("name").isNotNull() & (more[0] if more else F.lit(True)))
    g = each.groupBy("ordering").agg(counted(0, F.coalesce("_top", F.lit(False))).alias("coverage"), counted(0).alias("_all"), counted(1).alias("regions"))
    return g.select("ordering", "coverage", F.round(F.col("coverage") / F.nullif(F.col("_all"), F.lit(0)), 4).alias("share"), "regions")


def weighted_loss(rows: DataFrame, label: str, probability: Column, weight: Column) -> DataFrame:
    """``loss``: log-loss weighted by ``weight`` over all rows; null without weight."""
    return rows.agg((F.sum(weight * log_loss(F.col(label), probability)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("loss"))


def mean_of(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of the values there are, and how many; null without any."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("scored"))


def first_interactions(rows: DataFrame) -> DataFrame:
    """``render, event, first_ms`` of the earliest interaction of each event in each render."""
    return rows.groupBy("render", "event").agg(F.min("ts").alias("first_ms"))


def team_credit(clicks: DataFrame, items: DataFrame) -> DataFrame:
    """``render, event, team``: a click credits the team that placed the item in that list; clicks on anything else credit no one."""
    return clicks.select("render", "event").distinct().join(items.select("render", "event", "team"), ["render", "event"])


def catalogued(impressions: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Impressions with their record; ids that the catalog does not have are left out."""
    return impressions.join(catalog, key)


def training_window(rows: DataFrame, ts: str, label: str) -> DataFrame:
    """One row: first and last time, rows, positives, distinct UTC days."""
    return rows.agg(F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"), F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.countDistinct(F.floor(F.col(ts) / 86_400_000)).alias("days"))


def promotion(offline: DataFrame, organic: DataFrame, delta_low: Column, leak: Column, controls: Column) -> DataFrame:
    """One row of checks and a ``verdict``.

    ``offline`` has ``ordering, ndcg, coverage, regions``; ``organic`` one row with
    ``open``. The candidate must beat the best of the four baselines, win the organic
    interleaving, and keep nine tenths of the coverage and all regions. A closed gate
    leaves the verdict pending.
    """
    of = lambda name, c: F.max(F.when(F.col("ordering") == name, F.col(c)))
    baseline = F.col("ordering") != "candidate"
    place = sum((F.when(F.col("ordering") == n, i).otherwise(0) for i, n in enumerate(ORDERINGS)), F.lit(0))
    g = offline.agg(
        F.max_by(F.when(baseline, F.col("ordering")), F.when(baseline, F.struct(F.coalesce("ndcg", F.lit(-1.0)), -place))).alias("best_baseline"),
        F.max(F.when(baseline, F.coalesce("ndcg", F.lit(-1.0)))).alias("_best"),
        *[of(n, c).alias(f"_{n[0]}_{c}") for n in ("production", "candidate") for c in ("ndcg", "coverage", "regions")],
    )
    j = g.join(F.broadcast(organic.select("open")))  # one row each
    drop = 1 - F.col("_c_coverage") / F.nullif(F.col("_p_coverage"), F.lit(0))
    j = j.select(
        (~leak).alias("no_leakage"),
        controls.alias("controls_behaved"),
        F.coalesce(F.col("_c_ndcg") > F.col("_best"), F.lit(False)).alias("beats_baseline"),
        "best_baseline",
        F.coalesce(delta_low > 0, F.lit(False)).alias("wins_organic"),
        F.coalesce((drop <= 0.1) & (F.col("_c_regions") >= F.col("_p_regions")), F.lit(False)).alias("diversity_held"),
        F.col("open").alias("gate_met"),
    )
    every = F.col("no_leakage") & F.col("controls_behaved") & F.col("beats_baseline") & F.col("wins_organic") & F.col("diversity_held")
    return j.withColumn("verdict", F.when(~F.col("gate_met"), "Implemented result pending").when(every, "Promote").otherwise("Do not promote"))


def reads_future(features_before: Column, features_after: Column) -> Column:
    """A feature moved when fields that it must not read were changed."""
    return ~features_before.eqNullSafe(features_after)


def rank_mode(client: Column, model_known: bool) -> Column:
    """interleaved for a known client under a model; else production, for the cold start and the missing model alike."""
    return F.when(client.isNotNull() & F.lit(model_known), "interleaved").otherwise("production")


def same_order(one: DataFrame, other: DataFrame, by: str, rank: str, item: str) -> DataFrame:
    """``by, agrees``: whether two orderings of each list are the same sequence."""
    a = one.select(by, rank, F.col(item).alias("_a"))
    b = other.select(by, rank, F.col(item).alias("_b"))
    return a.join(b, [by, rank], "full_outer").groupBy(by).agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("agrees"))


def order_hash(rows: DataFrame, by: str, rank: str, item: str) -> DataFrame:
    """``by, sha256`` of each list's items in order, as a JSON array; lists are short."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item])
    return rows.groupBy(by).agg(F.sha2(F.to_json(ids), 256).alias("sha256"))


def scored_by_day(rows: DataFrame, models: DataFrame, day: str, label: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the score by their own day's model for a label; null where the day has none.

    Models are a row per day, so a join on the day brings each row its weights.
    """
    m = models.filter(F.col("label") == label).select(F.col("day").alias("_day"), F.col("weights").alias("_w"), F.col("bias").alias("_b"))
    z = F.aggregate(F.zip_with("features", "_w", lambda x, w: x * w), F.col("_b"), lambda a, x: a + x)
    return rows.join(m, F.col(day) == F.col("_day"), "left").select(*rows.columns, z.alias(name))


def shuffled_labels(rows: DataFrame, key: str, label: str, name: str = "shuffled") -> DataFrame:
    """``rows`` of distinct keys with ``name``: the label of the next key in order of the keys' hashes, the first's for the last.

    The order is as good as random, so the labels are, and their number stays.
    """
    k = numbered_keys(rows.select(key, label), key)
    n = k.agg(F.count("*").alias("_n"))
    turned = k.join(F.broadcast(n)).select(((F.col("k") + F.col("_n") - 1) % F.col("_n")).alias("k"), F.col(label).alias(name))  # one row
    return rows.join(k.join(turned, "k").select(F.col(key).alias("_key"), name), F.col(key) == F.col("_key")).select(*rows.columns, name)


def clustered_outcomes(drafts: DataFrame, clicked: DataFrame, client: DataFrame) -> DataFrame:
    """``render, client, value``: 1, 0 or -1 as the candidate, no one or production got more clicks in a drafted render.

    ``drafts`` has ``render, item, team``, ``clicked`` distinct ``render, item``, ``client`` ``render, client``.
    """
    sides = drafts.join(clicked.withColumn("_hit", F.lit(1)), ["render", "item"], "left").groupBy("render").agg(
        F.sum(F.when(F.col("team") == "candidate", F.col("_hit"))).alias("c"), F.sum(F.when(F.col("team") == "production", F.col("_hit"))).alias("p"), F.bool_or(F.col("team") == "candidate").alias("_drafted")
    )
    value = F.signum((F.coalesce("c", F.lit(0)) - F.coalesce("p", F.lit(0))).cast("double"))
    return sides.filter("_drafted").join(client, "render").select("render", "client", value.alias("value"))


def control_outcomes(rows: DataFrame) -> DataFrame:
    """``control, behaved`` of negative controls: a planted leak must be seen, shuffled labels must not win, and without a client or a model the list is the frozen one."""
    behaved = first_true((F.col("control") == "leak", "leak"), (F.col("control") == "shuffle", "shuffle"))
    return rows.select("control", F.when(behaved == "leak", F.col("detected") == F.col("planted")).when(behaved == "shuffle", F.coalesce(F.col("value") <= F.col("bound"), F.lit(False))).otherwise(F.col("same")).alias("behaved"))


def model_version(names: Sequence[str], hyperparameters: Mapping[str, float], eta: float, cap: float, rows: int, log_sha256: str, organic_rows: int) -> str:
    """``syn-`` or ``web-`` and ten digits of a hash over all that the training depends on."""
    whole = {"features": list(names), "hyperparameters": dict(hyperparameters), "eta": eta, "cap": cap, "rows": rows, "log": log_sha256}
    return ("web-" if organic_rows else "syn-") + hashlib.sha256(json.dumps(whole, separators=(",", ":")).encode()).hexdigest()[:10]


def rows_sha256(line: Column) -> Column:
    """An aggregate: a hash of a multiset of lines, whatever their order: sums of two parts of each line's hash, hashed."""
    part = lambda first: F.sum(F.conv(F.substring(F.sha2(line, 256), first, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws("/", part(1), part(16)), 256)


def version_of(names: Sequence[str], hyperparameters: Mapping[str, float], eta: float, cap: float, rows: Column, log_sha256: Column, organic_rows: Column) -> Column:
    """:func:`model_version` of many models at once."""
    head = json.dumps({"features": list(names), "hyperparameters": dict(hyperparameters), "eta": eta, "cap": cap}, separators=(",", ":"))[:-1]
    whole = F.concat(F.lit(head + ',"rows":'), rows.cast("string"), F.lit(',"log":"'), log_sha256, F.lit('"}'))
    return F.concat(F.when(organic_rows > 0, "web-").otherwise("syn-"), F.substring(F.sha2(whole, 256), 1, 10))


def rounded(x: float | None, places: int = 4) -> float | None:
    """:func:`brightquay.functions.scoring.fixed_places` of one number; nothing stays nothing."""
    if x is None or not math.isfinite(x):
        return None
    return float(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
