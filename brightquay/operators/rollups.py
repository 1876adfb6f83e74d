"""Counts and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_with_zeros(dimension: DataFrame, rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Counts per key of a dimension, keys without rows included; rows are summed up before they meet it."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    names = ["n", *counts]
    return dimension.select(key).distinct().join(g, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def distinct_by_source(rows: DataFrame, place: str, source: str, key: str, sources: Sequence[str], failed: DataFrame | None = None) -> DataFrame:
    """Distinct keys per place and source as columns, and over all sources; a failed source is null, an empty one 0."""
    wide = rows.groupBy(place).pivot(source, list(sources)).agg(F.countDistinct(key)).join(rows.groupBy(place).agg(F.countDistinct(key).alias("all")), place)
    bad = [] if failed is None else [r[0] for r in failed.select(source).distinct().collect()]
    return wide.select(place, *[(F.lit(None).cast("long") if s in bad else F.coalesce(F.col(f"`{s}`"), F.lit(0))).alias(s) for s in sources], "all")


def severities(rules: DataFrame) -> DataFrame:
    """``severity, n, messages`` of rule rows that fired."""
    return rules.filter("fired").groupBy("severity").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("message")).alias("messages"))


def health_rules(sources: DataFrame, now_ms: Column, stale_hours: float = 36) -> DataFrame:
    """Rule rows for ``source, n, floor, last_ms, error`` sources."""
    from brightquay.functions.text import error_class

    age = (now_ms - F.col("last_ms")) / 3.6e6
    rule = lambda name, severity, test: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(test, F.lit(False)).alias("fired"))
    rules = F.array(
        rule("stale", "failure", age > stale_hours),
        rule("below floor", "failure", F.col("n") < F.col("floor")),
        rule("misconfigured", "failure", error_class("error") == "misconfigured"),
        rule("throttled", "warning", error_class("error") == "throttled"),
        rule("empty", "note", F.col("n") == 0),
    )
    return sources.select("source", F.explode(rules).alias("r")).select("source", "r.*", F.concat_ws(": ", "source", "r.rule").alias("message"))


def reasons(rows: DataFrame, reason: Column) -> DataFrame:
    """``reason, n``: why rows are kept or skipped."""
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
