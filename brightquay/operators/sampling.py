"""Sorts, limits, rotation and seed retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def board_order(rows: DataFrame, over: Column, as_of: Column, start: str, ordinal: str, most: int) -> DataFrame:
    """Rows that are not over, or whose end is unknown, by start and input order, cut to ``most``."""
    return rows.filter(over.isNull() | (over >= as_of)).orderBy(F.coalesce(F.col(start), F.lit("9999")), ordinal).limit(most)


def view(rows: DataFrame, needle: str, *fields: str) -> DataFrame:
    """Rows whose fields contain the search text, in any case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.lower())))


def rotate(rows: DataFrame, index: str, total: int, size: int, slot: int) -> DataFrame:
    """The slice of a wrapping list that a slot is due."""
    return rows.filter(F.pmod(F.col(index) - F.lit((slot * size) % max(total, 1)), F.lit(max(total, 1))) < size)


def stratified(rows: DataFrame, stratum: str, default: str, index: str, size: int, slot: int) -> DataFrame:
    """One row of each stratum but the default, in turn, until ``size`` are picked; the default's share is the rest.

    Strata take their turn in the order of their first rows.
    """
    w = W.partitionBy(stratum)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(index)) - 1).withColumn("_n", F.count("*").over(w))
    others = rows.filter(F.col(stratum) != default).groupBy(stratum).agg(F.min(index).alias("_first"))
    turn = others.select(F.col(stratum).alias("_s"), F.row_number().over(W.orderBy("_first")).alias("_turn"))  # a row per stratum
    count = others.agg(F.count("*").alias("_others"))
    r = r.join(turn, F.col(stratum) == F.col("_s"), "left").crossJoin(F.broadcast(count))  # one row
    left = F.greatest(F.lit(0), F.lit(size) - F.col("_others"))
    due = F.when(F.col("_turn").isNotNull(), (F.col("_turn") <= size) & (F.col("_i") == F.pmod(F.lit(slot), F.col("_n")))).otherwise(F.pmod(F.col("_i") - F.pmod(slot * left, F.col("_n")), F.col("_n")) < left)
    return r.filter(due).select(*rows.columns)


def retain(rows: DataFrame, seen_ms: Column, now_ms: Column, days: int, url: str, most: int) -> DataFrame:
    """Rows seen within ``days`` or at an unknown time, by URL, cut to ``most``."""
    return rows.filter(seen_ms.isNull() | (seen_ms >= now_ms - days * 86400000)).orderBy(url).limit(most)


def promising_first(rows: DataFrame, promising: str, ordinal: str, most: int) -> DataFrame:
    """Promising rows first, each part in input order, cut to ``most``."""
    return rows.orderBy(F.desc(promising), ordinal).limit(most)


def near_misses(rows: DataFrame, candidates: DataFrame, url: str, short: str, relevance: str, most: int = 60) -> DataFrame:
    """What fell short, without the candidates, by how much and relevance, cut to ``most``."""
    return rows.join(candidates.select(url), url, "left_anti").orderBy(short, F.desc(relevance), url).limit(most)


def reserve_order(rows: DataFrame, region: str, ordinal: str, reserve: int) -> DataFrame:
    """``turn``: the first ``reserve`` rows of each region come before all others; nothing is left out."""
    w = W.partitionBy(region).orderBy(ordinal)
    return rows.withColumn("turn", F.struct(F.when(F.row_number().over(w) <= reserve, 0).otherwise(1).alias("late"), F.col(ordinal).alias("ordinal")))


def triage(rows: DataFrame, promising: Column, seen_ms: Column, now_ms: Column, recent_days: int = 3) -> DataFrame:
    """``tier`` 0 promising, 1 recent, 2 the rest."""
    return rows.withColumn("tier", F.when(promising, 0).when(seen_ms >= now_ms - recent_days * 86400000, 1).otherwise(2))


def headed(rows: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """``header``: the label where it differs from the one before in its list, else null."""
    before = F.lag(label).over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("header", F.when(~F.col(label).eqNullSafe(before), F.col(label)))
