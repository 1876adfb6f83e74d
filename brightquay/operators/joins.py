"""Lookups and joins: claims, enrichment, gap filling, as-of and range counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def claim_union(sources: Sequence[DataFrame], key: str, ordinal: str) -> DataFrame:
    """First claim wins: of rows with one key, the one of the earliest source, then of the least ordinal.

    The result has ``source_rank``. A struct minimum is combined on the map side, so a
    popular key is a row per task.
    """
    ranked = None
    for rank, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(rank))
        ranked = df if ranked is None else ranked.unionByName(df, allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "source_rank", ordinal)]
    best = ranked.groupBy(key).agg(F.min_by(F.struct("source_rank", ordinal, *rest), F.struct("source_rank", ordinal)).alias("r"))
    return best.select(key, "r.*")


def enrich(records: DataFrame, facts: DataFrame, key: str, facts_first: Sequence[str] = (), records_first: Sequence[str] = ()) -> DataFrame:
    """Left join with precedence by column: facts win some, records win others."""
    f = facts.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_f_{c}") for c in (*facts_first, *records_first)])
    j = records.join(f, F.col(key) == F.col("_k"), "left").drop("_k")
    for c in facts_first:
        j = j.withColumn(c, F.coalesce(F.col(f"_f_{c}"), F.col(c)) if c in records.columns else F.col(f"_f_{c}"))
    for c in records_first:
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_f_{c}")))
    return j.select(*records.columns, *[c for c in facts_first if c not in records.columns])


def gap_fill(records: DataFrame, snapshots: DataFrame, key: str, order: str, lead: str, fields: Sequence[str], skip: Column | None = None) -> DataFrame:
    """Fill nulls from the earliest snapshot that has ``lead``, else from the earliest at all.

    Rows for which ``skip`` holds are left alone.
    """
    held = snapshots.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*fields), F.struct(F.col(lead).isNull().alias("a"), F.col(order).alias("b"))).alias("_h"))
    j = records.join(held, F.col(key) == F.col("_k"), "left")
    keep = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    return j.select(*[F.when(keep, F.col(c)).otherwise(F.coalesce(F.col(c), F.col(f"_h.{c}"))).alias(c) if c in fields else F.col(c) for c in records.columns])


def lookup_first(records: DataFrame, text: Column, dimension: DataFrame, name: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Case-blind equality lookup in a dimension; of several rows the first in its own order."""
    d = dimension.groupBy(F.lower(F.trim(F.col(name))).alias("_n")).agg(F.min_by(F.struct(*fields), order).alias("_d"))
    j = records.withColumn("_t", F.lower(F.trim(text))).join(d, F.col("_t") == F.col("_n"), "left")
    return j.select(*records.columns, *[F.col(f"_d.{c}").alias(c) for c in fields])


def contains_join(texts: DataFrame, text: str, keys: DataFrame, key: str, least: int = 12) -> DataFrame:
    """For each text the longest key of at least ``least`` characters that it contains; repeated rows stay repeated.

    An equi-join on the keys' first ``least`` characters finds candidates of distinct
    texts; no pair of texts and keys is tried otherwise. Neither keys nor texts are
    broadcast: both grow with the input, and files tell little of the size of their text.
    """
    own = texts.select(F.col(text).alias("_text")).distinct()
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_text") - least + 1))
    grams = own.withColumn("_g", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col("_text"), i, F.lit(least))))))
    k = keys.filter(F.length(key) >= least).select(F.col(key).alias("_key")).distinct().withColumn("_h", F.substring("_key", 1, least))
    hit = grams.join(k.hint("merge"), F.col("_g") == F.col("_h")).filter(F.col("_text").contains(F.col("_key")))
    best = hit.groupBy("_text").agg(F.max_by("_key", F.struct(F.length("_key"), F.col("_key"))).alias("_best"))
    return texts.join(best.hint("merge"), F.col(text) == F.col("_text")).select(*texts.columns, F.col("_best").alias(key))


def slug_or_key_join(left: DataFrame, right: DataFrame, least: int = 18) -> DataFrame:
    """Rows of ``left`` (slug, key) that ``right`` knows: by slug where there is one, else by key or mutual containment."""
    by_slug = left.filter("slug IS NOT NULL").join(right.select("slug").filter("slug IS NOT NULL").hint("merge"), "slug", "left_semi")
    loose = left.filter("slug IS NULL")
    by_key = loose.join(right.select("key").hint("merge"), "key", "left_semi")
    rest = loose.join(right.select("key").hint("merge"), "key", "left_anti")
    inside = contains_join(rest.select("key").distinct(), "key", right.select(F.col("key").alias("other")), "other", least).select("key")
    around = contains_join(right.select(F.col("key").alias("whole")).distinct(), "whole", rest.select(F.col("key").alias("part")), "part", least).select(F.col("part").alias("key"))
    near = rest.join(inside.union(around).distinct().hint("merge"), "key", "left_semi")
    return by_slug.unionByName(by_key).unionByName(near)


def asof(left: DataFrame, right: DataFrame, by: str, at: str, take: Sequence[str]) -> DataFrame:
    """For each row of ``left`` the last row of ``right`` at or before it; rows without one are dropped.

    One shuffle on ``by``: both sides are put together and the last right row is carried
    forward in order of time, right rows first at equal times.
    """
    both = left.select(F.lit(1).alias("_side"), F.col(by), F.col(at), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r")).unionAll(
        right.select(F.lit(0), F.col(by), F.col(at), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType), F.struct(*take))
    )
    carried = both.withColumn("_r", F.last("_r", ignorenulls=True).over(W.partitionBy(by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)))
    return carried.filter("_side = 1 AND _r IS NOT NULL").select("_l.*", *[F.col(f"_r.{c}").alias(f"asof_{c}") for c in take])


def prior_counts(rows: DataFrame, by: str, at_ms: Column, counted: Column, name: str = "prior") -> DataFrame:
    """Count of ``counted`` rows of the same key strictly before each row."""
    w = W.partitionBy(by).orderBy(at_ms).rangeBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(counted.cast("long")).over(w), F.lit(0)))


def window_counts(queries: DataFrame, rows: DataFrame, by: str, at: str) -> DataFrame:
    """Rows with from <= time < to per query, and ``violates`` where the window ends after ``as_of``.

    Rows and the ends of all windows are put together, and one running count per key gives
    the rows before each end: one shuffle and one sort on the key, however wide windows are.
    """
    q = queries.withColumn("_q", F.monotonically_increasing_id())
    ends = F.array(F.struct(F.col("from_ms").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("to_ms").alias("t"), F.lit(1).alias("sign")))
    probes = q.select(F.col(by).alias("_b"), F.explode(ends).alias("_e"), "_q", F.struct(*queries.columns).alias("_row")).select("_b", "_e.t", "_e.sign", "_q", "_row")
    none = F.lit(None)
    hits = rows.select(F.col(by).alias("_b"), F.col(at).cast(probes.schema["t"].dataType).alias("t"), F.lit(0).alias("sign"), none.cast("long").alias("_q"), none.cast(probes.schema["_row"].dataType).alias("_row"))
    # at equal times ends come before rows, so only what is strictly earlier counts
    before = F.sum((F.col("sign") == 0).cast("long")).over(W.partitionBy("_b").orderBy("t", F.col("sign") == 0).rowsBetween(W.unboundedPreceding, 0))
    counted = probes.unionAll(hits).withColumn("_c", before).filter("sign <> 0")
    each = counted.groupBy("_q").agg(F.first("_row").alias("_row"), F.sum(F.col("sign") * F.col("_c")).alias("n"))
    return each.select("_row.*", F.greatest(F.lit(0), F.col("n")).alias("n")).withColumn("violates", F.col("to_ms") > F.col("as_of"))


def pending(board: DataFrame, synced: DataFrame, submitted: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are neither synced nor submitted."""
    return board.join(synced.select(key).hint("merge"), key, "left_anti").join(submitted.select(key).hint("merge"), key, "left_anti")


def ledger_check(recorded: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """``key, action``: adopt what is present and unrecorded, clear what is recorded and absent, keep the rest."""
    a, b = recorded.select(key).distinct().withColumn("_a", F.lit(True)), present.select(key).distinct().withColumn("_b", F.lit(True))
    action = F.when(F.col("_a").isNull(), "adopt").when(F.col("_b").isNull(), "clear").otherwise("keep")
    return a.join(b.hint("merge"), key, "full_outer").select(key, action.alias("action"))


def links_within(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node, depth`` of everything reachable from the seeds in ``depth`` steps of ``src, dst`` links."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def longest_text_per_link(links: DataFrame, key: str, text: str, nearby: str, least: int = 3, most: int = 180) -> DataFrame:
    """Per link the longest text: its own if it has more than ``least`` characters, else the head of what is near it; the first of equals."""
    said = F.when(F.length(text) > least, F.col(text)).otherwise(F.substring(nearby, 1, most))
    own = links.select(F.col(key), said.alias(text))
    return own.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), F.col(text))).alias(text))
