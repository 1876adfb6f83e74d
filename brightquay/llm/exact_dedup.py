"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their next bytes, round after round, until a group is a
singleton or its texts have ended. A group is named by its smallest row, so no
digest decides equality: two rows share a group only when all bytes read so far
are the same. The digit grows from round to round, so the number of rounds follows
the logarithm of the longest repeated text.

Every round is a counting aggregation with map-side combine (a hot group is one row
per task) and a left join of the groups of two and more, which adaptive execution
broadcasts when small and splits when skewed. Only rows of undecided groups go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import WHITE, Scratch, drop_table, free_name, load, numbered, text_of, write_table

#: Bytes of the first digit, its growth a round, and its bound.
FIRST_DIGIT, GROWTH, LARGEST_DIGIT = 64, 16, 1 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every row under equality of white-space-free texts.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.
    The row with the most code points in its original text stays, then the smallest
    id. Null texts are empty; empty texts equal each other. A null id sorts first.
    Rows repeated with the same id and text stay together and are all marked kept
    when theirs is the id that stays. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_cp"), F.translate("t", WHITE, "").cast("binary").alias("rest")
    )
    rows = rows.withColumn("sha", F.sha2("rest", 256))
    state = rows.withColumn("gid", F.struct(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit("").alias("sha")))
    digit, done, before = FIRST_DIGIT, [], None
    while True:
        keyed = state.withColumn("digit", F.substring("rest", 1, digit)).withColumn("ended", F.length("rest") <= digit)
        groups = write_table(
            keyed.groupBy("gid", "digit", "ended")
            .agg(F.count("*").alias("n"), F.min(F.struct((-F.col("n_cp")).alias("less"), "doc_id")).alias("best"), F.min(F.struct("doc_id", "sha")).alias("next"))
            .filter("n > 1"),
            "radix-groups",
        )
        a, b = keyed.alias("a"), groups.alias("b")
        same = F.col("a.gid").eqNullSafe(F.col("b.gid")) & (F.col("a.digit") == F.col("b.digit")) & (F.col("a.ended") == F.col("b.ended"))
        over = F.col("b.n").isNull() | F.col("a.ended")
        after = write_table(
            a.join(b, same, "left").select(
                "a.doc_id",
                "a.n_cp",
                "a.sha",
                F.when(over, F.lit(None)).otherwise(F.expr(f"substring(a.rest, {digit + 1})")).alias("rest"),
                F.col("b.next").alias("gid"),
                over.alias("over"),
                F.coalesce(F.col("b.n"), F.lit(1)).cast("long").alias("group_size"),
                F.when(F.col("b.n").isNull(), F.col("a.doc_id")).otherwise(F.col("b.best.doc_id")).alias("keep_id"),
            ),
            "radix-state",
        )
        drop_table(groups)
        done.append(after.filter("over").select("doc_id", "keep_id", "group_size", "sha"))
        state = after.filter("not over").select("doc_id", "n_cp", "sha", "rest", "gid")
        if state.isEmpty():
            break
        digit = min(digit * GROWTH, LARGEST_DIGIT)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all its columns unchanged; of rows with the same id and length, the first one.

    What goes is written first: it is the smaller part, and its size decides how the texts
    meet it.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    keyed = rows.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("_row")).alias("_key"), F.col(text_col).alias("_text"))
    with Scratch() as scratch:
        gone = exact_groups(keyed, "_key", "_text").filter("NOT kept").select(F.col("doc_id._row").alias(row))
        gone = scratch.keep(write_table(gone, "copies"))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return exact_groups(load(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(s) AS text_sha256
FROM n
"""
