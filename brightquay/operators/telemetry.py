"""Telemetry: validation, sessions, credit and organic counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that fails; null when none does. A null test counts as failed."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for bad, reason in checks])


def telemetry_reason(now_ms: Column, domains: dict[str, Sequence[str]], id_pattern: str = r"^[A-Za-z0-9_-]{16,64}\z", ahead_ms: int = 600_000) -> Column:
    """Reason why a telemetry row is refused, in a fixed order of checks."""
    checks = [(~F.col(c).isin(list(values)), c) for c, values in domains.items()]
    checks += [
        ((F.col("ts") < 1_600_000_000_000) | (F.col("ts") > now_ms + ahead_ms), "ts"),
        (~F.col("client_id").rlike(id_pattern), "client_id"),
        (~F.col("session_id").rlike(id_pattern), "session_id"),
        ((F.length("event_id") < 1) | (F.length("event_id") > 80), "event_id"),
        ((F.col("position") < 0) | (F.col("position") > 999), "position"),
    ]
    return first_reason(*checks)


def accept_batches(rows: DataFrame, batch: str, reason: str, most: int = 50) -> DataFrame:
    """``batch, n, bad, accepted``: a batch of 1 to ``most`` rows without a bad one."""
    g = rows.groupBy(batch).agg(F.count("*").alias("n"), F.count(reason).alias("bad"))
    return g.withColumn("accepted", (F.col("n") <= most) & (F.col("bad") == 0))


def gap_sessions(rows: DataFrame, by: Sequence[str], at_ms: Column, gap_ms: int, name: str = "session") -> DataFrame:
    """Number of a row's session within its key: a new one after more than ``gap_ms``."""
    w = W.partitionBy(*by).orderBy(at_ms)
    starts = F.when(F.lag(at_ms).over(w).isNull() | (at_ms - F.lag(at_ms).over(w) > gap_ms), 1).otherwise(0)
    return rows.withColumn("_s", starts).withColumn(name, F.sum("_s").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_s")


def renders(impressions: DataFrame, by: Sequence[str] = ("client_id", "session_id"), gap_ms: int = 5000) -> DataFrame:
    """``by, render, items``: a list shown at once.

    In order of time and position a render ends when a position comes again or after a
    gap. The set of seen positions starts anew with each render, so this is a fold over the
    session's sorted impressions. It notes only where renders begin; they are then cut out
    of the session as slices, without copying and without a second shuffle.
    """
    typed = impressions.select(*by, F.col("ts").cast("long").alias("ts"), F.col("position").cast("int").alias("position"), F.col("event_id").cast("string").alias("event_id"))
    sessions = typed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts", "position", "event_id"))).alias("_i"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("begins"), none.alias("seen"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        anew = (a["at"] == 1) | F.array_contains(a["seen"], x["position"]) | (x["ts"] - a["last"] > gap_ms)
        begins, seen = F.when(anew, F.concat(a["begins"], F.array(a["at"]))).otherwise(a["begins"]), F.concat(F.when(anew, none).otherwise(a["seen"]), F.array(x["position"]))
        return F.struct(begins.alias("begins"), seen.alias("seen"), x["ts"].alias("last"), (a["at"] + 1).alias("at"))

    cuts = sessions.withColumn("_b", F.aggregate("_i", start, step, lambda a: a["begins"]))
    lists = F.transform("_b", lambda b, k: F.slice("_i", b, F.coalesce(F.get("_b", k + 1), F.size("_i") + 1) - b))
    each = cuts.select(*by, F.posexplode(lists).alias("_k", "_l"))
    items = F.array_sort(F.transform("_l", lambda x: F.struct(x["position"].alias("position"), x["event_id"].alias("event_id"))))
    return each.select(*by, (F.col("_k") + 1).alias("render"), F.get("_l", F.lit(0))["ts"].alias("ts"), items.alias("items"))


def organic_counts(rows: DataFrame, organic: Column, impression: Column, client: str, day: Column) -> DataFrame:
    """One row: impressions, interactions, distinct clients and days of organic rows, and rows left out."""
    ok = F.coalesce(organic, F.lit(False))
    return rows.agg(
        F.count_if(ok & impression).alias("impressions"),
        F.count_if(ok & ~impression).alias("interactions"),
        F.countDistinct(F.when(ok, F.col(client))).alias("clients"),
        F.countDistinct(F.when(ok, day)).alias("days"),
        F.count_if(~ok).alias("excluded"),
    )


def gate(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """``open`` when every count reaches its least value."""
    test = F.lit(True)
    for c, n in least.items():
        test = test & (F.col(c) >= n)
    return counts.withColumn("open", test)


def arm_table(rows: DataFrame, arms: Sequence[str], shown: Column, clicked: Column) -> DataFrame:
    """Impressions, clicks, click rate and its Wilson interval by arm."""
    from brightquay.functions.scoring import wilson

    g = rows.groupBy(*arms).agg(F.count_if(shown).alias("impressions"), F.count_if(clicked).alias("clicks"))
    g = g.withColumn("ctr", F.col("clicks") / F.nullif(F.col("impressions"), F.lit(0))).withColumn("_w", wilson(F.col("clicks"), F.col("impressions")))
    return g.select(*arms, "impressions", "clicks", "ctr", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"))


def draft_outcomes(credits: DataFrame) -> DataFrame:
    """``render, team`` click credits to wins, losses, ties and the mean difference of the candidate."""
    per = credits.groupBy("render").agg(F.count_if(F.col("team") == "candidate").alias("c"), F.count_if(F.col("team") == "production").alias("p"))
    return per.agg(F.count("*").alias("renders"), F.count_if(F.expr("c > p")).alias("wins"), F.count_if(F.expr("c < p")).alias("losses"), F.count_if(F.expr("c = p")).alias("ties"), F.avg(F.signum(F.col("c") - F.col("p"))).alias("delta"))
