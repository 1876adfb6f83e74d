"""Mixing sources to target weights with distributed prefix sums.

Every document gets a hash-random key. Within each source the key range is cut into
equal slices, so that no task holds more than a slice; sizes are summed per slice, the
slice sums are prefix-summed, and a window inside each slice adds the rest. A source's
budget is cut exactly: whole epochs first, then the documents in key order, the last
one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightquay.llm.common import WORD, Scratch, free_name, load, numbered, text_of, write_table

#: Rows that a slice of a source's key range holds on average.
SLICE_ROWS = 4096
#: Keys are 60-bit.
KEY_BITS = 60
#: Weights of the sources in order of their names, repeating, and the most epochs.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of ``(source, n_rows, source_size)`` rows; adds ``target``.

    Weights repeat over the sources by code point, null last, and share 100% of all
    sizes. A target stops at ``epochs`` times its source's size; what is over is shared
    again by weight until none is above: the sources in order of cap per weight, the
    first one whose cap covers the common level ends the capped ones. Sources without
    words have target 0. The table has a row per source, so one window task is enough.
    """
    ranked = sources.withColumn("k", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    x = ranked.withColumn("w", weigh).withColumn("cap", F.col("source_size") * epochs)
    whole = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("w"), "k")
    x = (
        x.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("fits", F.col("cap") >= F.col("level") * F.col("w"))
        .withColumn("first", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("k"), F.col("level")))).over(whole))
    )
    share = F.when((F.col("cap") / F.col("w") < F.col("first.col1")) | ((F.col("cap") / F.col("w") == F.col("first.col1")) & (F.col("k") < F.col("first.k"))), F.col("cap").cast("double")).otherwise(
        F.col("first.level") * F.col("w")
    )
    return x.select("source", "n_rows", "source_size", share.cast("double").alias("target"))


def random_key(seed: str) -> Column:
    """The hash-random key of a row's id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, KEY_BITS // 4), 16, 10).cast("long")


def word_count() -> Column:
    """Words of a row's text."""
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per row of ``docs``.

    A size is the number of words, 0 for null and empty texts, which then have taken 0.
    Taken words of a source add up to its rounded target; the document at the cut is
    taken in part. Keys come from the id and the seed alone, so reruns agree; ties (the
    same id twice) go by size. A null id has a key like any other. Empty table, empty
    result; of further columns, those named in ``also`` are passed on and end ties.
    """
    rows = docs.select("doc_id", "source", word_count().alias("size"), *also).withColumn("key", random_key(seed))
    rows = write_table(rows, "mix-sizes")  # texts are read once; sizes are used three times
    targets = source_targets(rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), weights, epochs)
    # slices of a source's key range, a power of two of them
    shift = F.lit(KEY_BITS) - F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / SLICE_ROWS))).cast("int")
    targets = targets.withColumn("shift", shift)
    s, t = rows.alias("s"), targets.alias("t")
    rows = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("doc_id", "s.source", "size", "key", "source_size", "target", F.expr("shiftright(key, shift)").alias("slice"), *also)
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = sums.select(
        F.col("source").alias("b_source"),
        F.col("slice").alias("b_slice"),
        F.coalesce(F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("slices_before"),
    )
    inside = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *also).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    placed = rows.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("slice") == F.col("b_slice")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - F.col("whole") * F.col("source_size")
    start = F.col("slices_before") + F.col("upto") - F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.withColumn("whole", whole).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + cut).cast("long").alias("taken"), *also)


def apply_mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix as documents: a document taken r times in full is r rows, and one row of its first words, with single blanks, for a part.

    What the mix decides comes down to a row per source, the number of whole epochs and the
    row at the cut, so texts meet a table of sources and are not shuffled. Columns are those of ``docs``; ``n_chars`` follows a cut text where the column is there.
    """
    row, size, took, words, own, last = (free_name(docs, x) for x in ("_row", "_size", "_taken", "_words", "_source", "_last"))
    rows = numbered(docs, row)
    with Scratch() as scratch:
        mixed = mix(rows.select("doc_id", "source", "text", F.col(row).alias("_row")), seed, also=("_row",), **options)
        whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
        extra = F.col("taken") - whole * F.col("size")
        cut = F.struct(random_key(seed).alias("key"), "doc_id", "size", "_row", extra.alias("extra"))
        # in order of the keys rows are taken once more up to each source's last one, which is taken in part
        cuts = mixed.groupBy("source").agg(F.first(whole).alias("whole"), F.max(F.when(extra > 0, cut)).alias("cut"))
        cuts = scratch.keep(write_table(cuts.select(F.col("source").alias(own), F.struct("whole", "cut").alias(last)), "cuts"))
    x = rows.withColumn(size, word_count()).join(cuts, F.col("source").eqNullSafe(F.col(own)))
    at, end = F.struct(random_key(seed).alias("key"), F.col("doc_id"), F.col(size).alias("size"), F.col(row).alias("_row")), F.col(f"{last}.cut")
    until = F.struct(*[end[c].alias(c) for c in ("key", "doc_id", "size", "_row")])
    more = F.when(end.isNull() | (at > until), F.lit(0)).when(at < until, F.col(size)).otherwise(end["extra"])
    x = x.withColumn(took, F.col(f"{last}.whole") * F.col(size) + more).filter(F.col(took) > 0)
    n, rest = F.col(size).cast("int"), (F.col(took) % F.col(size)).cast("int")
    times = F.expr(f"int({took} div {size})")
    x = x.withColumn(words, F.explode(F.concat(F.array_repeat(n, times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    full = F.col(words) == F.col(size)
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    head = F.array_join(F.slice(split, F.lit(1), F.col(words)), " ")
    new = {"text": F.when(full, F.col("text")).otherwise(head)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(full, F.col("n_chars")).otherwise(F.length(head).cast(docs.schema["n_chars"].dataType))
    return x.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT *, min(CASE WHEN cap >= level * w THEN [cap / w, k::DOUBLE, level] END) OVER () AS first FROM l
), t AS (
  SELECT *, CASE WHEN cap / w < first[1] OR (cap / w = first[1] AND k < first[2]) THEN cap::DOUBLE ELSE first[3] * w END AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole,
         CAST(round(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - start)) AS BIGINT) AS taken FROM r
"""
