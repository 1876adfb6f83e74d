"""Ranking: measures, drafts, bootstrap intervals and the click model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightquay.functions.scoring import discounted, ideal_gain
from brightquay.operators.descent import fit_all
from brightquay.session import scratch

#: Clients of a bootstrap's slice, and draws that a task makes of one.
SLICE_CLIENTS, BLOCK_DRAWS = 1 << 17, 40


def ranked(rows: DataFrame, by: Sequence[str], *order) -> DataFrame:
    """``rank`` from 0 within each list; the last key of ``order`` has to break ties."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def list_measures(rows: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """NDCG@k, reciprocal rank and recall@k per list of ``rank, relevant`` rows; null without relevant rows."""
    g = rows.groupBy(*by).agg(
        F.sum(F.col("relevant").cast("long")).alias("n_relevant"),
        F.sum(F.when(F.col("relevant") & (F.col("rank") < k), discounted(F.col("rank"))).otherwise(0.0)).alias("gain"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum((F.col("relevant") & (F.col("rank") < k)).cast("long")).alias("hits"),
    )
    some = F.col("n_relevant") > 0
    return g.select(
        *by,
        F.when(some, F.col("gain") / ideal_gain(F.col("n_relevant"), k)).alias("ndcg"),
        F.when(some, 1 / (F.col("first") + 1)).alias("mrr"),
        F.when(some, F.col("hits") / F.col("n_relevant")).alias("recall"),
    )


def coverage(rows: DataFrame, item: str, k: int = 10) -> DataFrame:
    """Distinct items within the first ``k`` places of any list."""
    return rows.filter(F.col("rank") < k).agg(F.countDistinct(item).alias("coverage"))


class Mulberry:
    """The 32-bit generator of drafts and shuffles: a step constant and two multiply-and-shift mixes (fixed values)."""

    STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF

    def __init__(self, seed: int):
        self.state = seed & self.MASK

    def __call__(self) -> float:
        self.state = (self.state + self.STEP) & self.MASK
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & self.MASK
        t ^= (t + (t ^ t >> 7) * (t | 61)) & self.MASK
        return ((t ^ t >> 14) & self.MASK) / 4294967296


def fnv1a_text(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
    return h


def draft(production: Sequence, candidate: Sequence, rng: Callable[[], float]) -> list[tuple]:
    """Team draft: ``(item, team)`` in order, as many as the production list has; the team with fewer picks goes next and the generator settles ties."""
    lists, at, picks = {"production": list(production), "candidate": list(candidate)}, {"production": 0, "candidate": 0}, {"production": 0, "candidate": 0}
    out, taken = [], set()

    def waiting(team: str):
        while at[team] < len(lists[team]) and lists[team][at[team]] in taken:
            at[team] += 1
        return at[team] < len(lists[team])

    while len(out) < len(lists["production"]):
        p, c = waiting("production"), waiting("candidate")
        if not (p or c):
            break
        if p and c:
            team = "production" if picks["production"] < picks["candidate"] else "candidate" if picks["candidate"] < picks["production"] else "production" if rng() < 0.5 else "candidate"
        else:
            team = "production" if p else "candidate"
        item = lists[team][at[team]]
        taken.add(item)
        picks[team] += 1
        out.append((item, team))
    return out


def team_drafts(lists: DataFrame, key: str = "key") -> DataFrame:
    """``key, place, item, team`` from ``key, production, candidate`` rows; the key seeds the generator."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, x, t) for k, p, c in zip(f[key], f["production"], f["candidate"], strict=True) for i, (x, t) in enumerate(draft(p, c, Mulberry(fnv1a_text(str(k)))))]
            yield pd.DataFrame(rows, columns=[key, "place", "item", "team"])

    kind = lists.schema["production"].dataType.elementType.simpleString()
    return lists.mapInPandas(of, f"{key} {lists.schema[key].dataType.simpleString()}, place int, item {kind}, team string")


def shuffled(items: Sequence, seed: int) -> list:
    """Fisher-Yates from the end with the 32-bit generator."""
    out, rng = list(items), Mulberry(seed)
    for i in range(len(out) - 1, 0, -1):
        j = math.floor(rng() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def numbered_keys(rows: DataFrame, key: str, name: str = "k") -> DataFrame:
    """``rows`` of distinct keys with a number from 0, in order of three hex digits of the key's hash and the key.

    Keys are numbered within the 4,096 slices that these digits make, and the slices' sizes
    are added up, so no task sees more than a slice.
    """
    piece = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3)
    r = rows.withColumn("_slice", piece)
    sizes = r.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_slice").alias("_of"), (F.sum("_n").over(W.orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = r.withColumn("_i", F.row_number().over(W.partitionBy("_slice").orderBy(key)) - 1)
    return inside.join(before, F.col("_slice") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_i")).select(*rows.columns, name)


def _mulberry_at(seed: int, k: np.ndarray) -> np.ndarray:
    """:func:`brightquay.functions.scoring.mulberry` of many numbers at once."""
    t = (np.uint64(seed & Mulberry.MASK) + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(Mulberry.STEP)).astype(np.uint32)
    t = (t ^ t >> np.uint32(15)) * (t | np.uint32(1))
    t ^= t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))
    return (t ^ t >> np.uint32(14)) / 4294967296.0


def bootstrap_mean(values: DataFrame, client: str, value: str, draws: int = 2000, seed: int = 4242, level: float = 0.95) -> DataFrame:
    """``mean, low, high`` of ``value``, clients drawn with replacement; no interval for fewer than two clients.

    Clients are reduced to sums and counts first. Pick i of draw d is the generator's
    number d * clients + i, reckoned by itself, so draws are made in parallel; quantiles
    are taken by index. Numbered clients are put together in slices, and a task adds up
    what a few draws pick from one: picks are never rows.
    """
    per = values.groupBy(client).agg(F.sum(value).alias("s"), F.count(value).alias("n")).filter("n > 0")
    total = per.count()
    slices = numbered_keys(per, client).groupBy(F.floor(F.col("k") / SLICE_CLIENTS).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("k", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n")))).alias("c"))
    blocks = values.sparkSession.range(-(-draws // BLOCK_DRAWS)).withColumnRenamed("id", "block")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, s, n, block in zip(f["slice"], f["s"], f["n"], f["block"], strict=True):
                first = at * SLICE_CLIENTS
                rows = []
                for draw in range(block * BLOCK_DRAWS, min(draws, (block + 1) * BLOCK_DRAWS)):
                    sums = np.zeros(2)
                    for start in range(0, total, SLICE_CLIENTS):
                        pick = np.arange(draw * total + start, draw * total + min(total, start + SLICE_CLIENTS))
                        k = np.floor(_mulberry_at(seed, pick) * total).astype(np.int64) - first
                        k = k[(k >= 0) & (k < len(s))]
                        sums += s[k].sum(), n[k].sum()
                    rows.append((draw, *sums))
                yield pd.DataFrame(rows, columns=["draw", "s", "n"])

    dealt = slices.select("slice", F.col("c.s").alias("s"), F.col("c.n").alias("n")).crossJoin(F.broadcast(blocks)).repartition(max(1, blocks.count()), "block", "slice")
    drawn = dealt.mapInPandas(of, "draw long, s double, n double").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("v"))
    tail = (1 - level) / 2
    quantile = lambda q: F.when(F.lit(total > 1), F.element_at("vs", min(draws - 1, math.floor(q * draws)) + 1))
    spread = drawn.agg(F.sort_array(F.collect_list("v")).alias("vs"))
    spread = spread.select(F.when(F.size("vs") > 0, quantile(tail)).alias("low"), F.when(F.size("vs") > 0, quantile(1 - tail)).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(F.broadcast(spread))  # one row each


@dataclass
class ClickModel:
    """Weights of the logistic click model."""

    weights: np.ndarray
    bias: float

    def acceptable(self, names: Sequence[str], expected: Sequence[str]) -> bool:
        """Names in order, one finite weight each, and a finite bias."""
        return list(names) == list(expected) and len(self.weights) == len(expected) and bool(np.isfinite(self.weights).all()) and math.isfinite(self.bias)


def model_of(artifact: Column) -> Column:
    """A model's JSON as a struct; null fields, or null altogether, where it is malformed or of other types."""
    return F.from_json(artifact, "feature_names array<string>, weights array<double>, bias double, model_version string")


def accepted(model: Column, expected: Sequence[str]) -> Column:
    """Whether a model's names are the expected ones in order, with a finite weight each, a finite bias and a version; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    names, weights = model["feature_names"], model["weights"]
    shape = (names == F.array(*map(F.lit, expected))) & (F.size(weights) == len(expected))
    return F.coalesce(shape & F.forall(weights, finite) & finite(model["bias"]) & (F.length(model["model_version"]) > 0), F.lit(False))


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in an order of all rows.

    The order is a range shuffle, so keys of equal rows are split by what else ``order``
    names. The sorted rows are written once with part and place in the part; then parts'
    sizes are added up, a row per part.
    """
    spark, at = rows.sparkSession, scratch(rows.sparkSession, "placed")
    rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")).write.parquet(at)
    written = spark.read.parquet(at)
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_of"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return written.join(before, F.col("_part") == F.col("_of")).select(*rows.columns, (F.col("_before") + F.col("_i") + 1).alias(name))


def fit_clicks(rows: DataFrame, features: str = "features", label: str = "label", weight: str = "weight", **options) -> ClickModel:
    """Full-batch gradient descent on weighted log-loss, the bias without penalty: passes of Spark over the summed-up rows, whatever their number."""
    return ClickModel(*fit_all(rows, features, label, weight, **options))


def prequential_days(rows: DataFrame, ts_ms: str, least: int = 200) -> DataFrame:
    """``day_start, n_before`` of days with at least ``least`` rows before them: a model of a day sees only these."""
    day = (F.floor(F.col(ts_ms) / 86400000) * 86400000).alias("day_start")
    per = rows.groupBy(day).agg(F.count("*").alias("n"))
    before = per.withColumn("n_before", F.coalesce(F.sum("n").over(W.orderBy("day_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return before.filter(F.col("n_before") >= least).select("day_start", "n_before", "n")


def moved_features(before: DataFrame, after: DataFrame, key: str, features: str = "features") -> DataFrame:
    """Rows whose features moved when fields that they must not read were changed: a leak."""
    a = after.select(F.col(key).alias("_k"), F.col(features).alias("_f"))
    return before.join(a, F.col(key) == F.col("_k")).filter(~F.col(features).eqNullSafe(F.col("_f"))).select(key)
