"""Snapshots: reconciliation, field changes, tombstones, seed merges and guards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = ("title", "start", "end", "status", "venue", "prize")


def first_per_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def reconcile(previous: DataFrame, current: DataFrame, key: str, gone: Column, budget: int, misses: str = "missed") -> DataFrame:
    """Every key of both snapshots with ``state`` and ``missed``.

    current rows are added or present with no misses; rows that only the previous
    snapshot has are carried with one miss more, or removed when ``gone`` (a condition on
    previous columns) holds or the budget is used up. A carried row keeps its values.
    """
    p, c = previous.alias("p"), current.alias("c")
    missed = F.coalesce(F.col(f"p.{misses}"), F.lit(0)) + 1
    state = F.when(F.col(f"p.{key}").isNull(), "added").when(F.col(f"c.{key}").isNotNull(), "present").when(gone | (missed > budget), "removed").otherwise("carried")
    fields = [f for f in current.columns if f != key and f != misses]
    return p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer").select(
        F.coalesce(f"c.{key}", f"p.{key}").alias(key),
        state.alias("state"),
        F.when(F.col(f"c.{key}").isNotNull(), 0).otherwise(missed).cast("int").alias("missed"),
        *[F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{f}")).otherwise(F.col(f"p.{f}")).alias(f) for f in fields],
    )


def field_changes(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str] = TRACKED) -> DataFrame:
    """``key, field, was, now`` for tracked fields that differ in rows of both snapshots; null differs from a value."""
    p, c = previous.alias("p"), current.alias("c")
    j = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"))
    diffs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p.{f}").cast("string").alias("was"), F.col(f"c.{f}").cast("string").alias("now")) for f in fields])
    long = j.select(F.col(f"c.{key}").alias(key), F.explode(diffs).alias("d")).select(key, "d.*")
    return long.filter(~F.col("was").eqNullSafe(F.col("now")))


def change_set(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``key, change`` for rows that came or went."""
    added = current.select(key).join(previous.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = previous.select(key).join(current.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def apply_tombstones(rows: DataFrame, tombstones: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Deleted keys go; redacted ones have the named fields blanked and listed in ``redacted``."""
    deleted = tombstones.filter("action = 'delete'").select(key)
    redact = tombstones.filter("action = 'redact'").select(F.col(key).alias("_k"), F.col("fields").alias("_f"))
    j = rows.join(deleted, key, "left_anti").join(redact, F.col(key) == F.col("_k"), "left")
    hit = lambda f: F.coalesce(F.array_contains("_f", f), F.lit(False))
    return j.select(*[F.when(hit(c), F.lit("[redacted]")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns], F.coalesce("_f", F.array().cast("array<string>")).alias("redacted"))


def merge_seeds(older: DataFrame, newer: DataFrame, key: str, scalars: Sequence[str], maps: Sequence[str] = ()) -> DataFrame:
    """Union of two seed tables: the newer side's values win, maps are merged, nothing is erased by absence."""
    o, n = older.alias("o"), newer.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    merged = lambda m: F.map_concat(F.map_filter(F.coalesce(F.col(f"o.{m}"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(F.col(f"n.{m}"), k), F.lit(False))), F.coalesce(F.col(f"n.{m}"), F.create_map().cast("map<string,string>")))
    return j.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in scalars], *[merged(m).alias(m) for m in maps])


def collapse_guard(counts: DataFrame, floor: int = 12, share: float = 0.5) -> DataFrame:
    """``previous, now`` rows with ``least`` and ``refuse``: a fall below the floor or half of a baseline that was not empty."""
    least = F.greatest(F.lit(floor), F.ceil(F.col("previous") * share))
    return counts.withColumn("least", least.cast("long")).withColumn("refuse", (F.col("previous") > 0) & (F.col("now") < least))


def check_collapse(previous: int, now: int, floor: int = 12, share: float = 0.5) -> None:
    """Raise before anything is published when a sweep has collapsed."""
    if previous > 0 and now < max(floor, math.ceil(previous * share)):
        raise RuntimeError(f"{now} records after {previous}: refusing to publish")


def last_baseline(snapshots: DataFrame, count: str, order: str) -> DataFrame:
    """Count of the last snapshot that was not empty."""
    return snapshots.filter(F.col(count) > 0).agg(F.max_by(count, order).alias("previous"))


def ledger_transition(ledger: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Apply one outcome per id (``outcome`` synced, submitted or failed, ``message``).

    Synced clears the rest; submitted keeps its reason; a failure adds an attempt and keeps
    300 characters of its message.
    """
    j = ledger.alias("l").join(events.alias("e"), F.col(f"l.{key}") == F.col(f"e.{key}"), "full_outer")
    failed, some = F.col("e.outcome") == "failed", F.col("e.outcome").isNotNull()
    return j.select(
        F.coalesce(f"l.{key}", f"e.{key}").alias(key),
        F.coalesce("e.outcome", "l.state").alias("state"),
        F.when(failed, F.coalesce("l.attempts", F.lit(0)) + 1).when(some, 0).otherwise(F.coalesce("l.attempts", F.lit(0))).alias("attempts"),
        F.when(some, F.when(F.col("e.outcome") != "synced", F.substring("e.message", 1, 300))).otherwise(F.col("l.message")).alias("message"),
    )


def carried_provenance(kind: Column, file: Column, sha: Column, inherited_hash: Column, recomputed: Column, inherited_at: Column, snapshot_at: Column, missed: Column) -> Column:
    """Provenance of a carried row: its file, the inherited or recomputed hash, and when it was last seen for certain."""
    return F.struct(kind.alias("kind"), F.array(F.struct(file.alias("file"), sha.alias("sha256"))).alias("inputs"), F.coalesce(inherited_hash, recomputed).alias("contentSha256"), F.coalesce(inherited_at, F.when(missed == 0, snapshot_at)).alias("lastConfirmedAt"))
