r"""Chat formatting with relational and array expressions only.

Turn structs are collected in blocks of turn numbers and sorted, adjacent turns of a
role are merged with array aggregation inside the block, and the blocks of a
conversation are joined in order. The blocks bound what one aggregation collects from
raw rows: a conversation that holds a third of all rows is gathered from many tasks. Turns
that share a number, or have none, are one block; its work grows in proportion to it.

The template is ``### role``, a line feed, the texts of adjacent turns of that role
parted by ``<+>``, then ``</turn>`` and a line feed. ``#``, ``<`` and the backslash
are escaped in texts and roles (a line feed too in roles), each as a backslash and a
letter, so that no control string can arise inside a text and escaping is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import load

#: Turn numbers of one block.
BLOCK = 64
OPEN, BETWEEN, CLOSE = "### ", "<+>", "</turn>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards the text holds neither ``#`` nor ``<``."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`; every backslash of an escaped text begins a pair."""
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments``.

    ``segments`` is an array of ``(text, loss)`` whose texts make up ``formatted`` in
    order; ``loss`` marks the texts of ``assistant``. Turns go by turn number, nulls
    first, then by role and text. Null roles and texts count as empty; a null conv_id
    is a conversation of its own. Rows that repeat are turns of their own. No rows, no
    conversations; further columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # a run begins where the role is not the one before; it goes on to where the next one begins
    role = lambda i: F.get(F.col("ts"), i)["role"]
    starts = sorted_.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (role(i) != role(i - 1))))
    texts = lambda s, j: F.transform(F.slice("ts", s + 1, F.coalesce(F.get(F.col("at"), j + 1), F.size("ts")) - s), lambda t: t["text"])
    blocks = starts.select("conv_id", "block", F.transform("at", lambda s, j: F.struct(role(s).alias("role"), texts(s, j).alias("texts"))).alias("runs"))
    runs = blocks.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block").isNotNull().alias("last"), "block", "runs"))), lambda b: b.runs)).alias("r"))

    def pieces(x: Column, i: Column) -> Column:
        """A run's segments; a run that goes on with its predecessor's role has no head, one that is gone on with has no end."""
        goes_on = (i > 0) & (F.get(F.col("r"), i - 1)["role"] == x["role"])
        gone_on = F.coalesce(F.get(F.col("r"), i + 1)["role"] == x["role"], F.lit(False))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.when(goes_on, F.lit(BETWEEN)).otherwise(F.concat(F.lit(OPEN), _escape_role(x["role"]), F.lit("\n")))
        texts = F.flatten(
            F.transform(
                x["texts"],
                lambda t, k: F.array(part(F.when(k > 0, F.lit(BETWEEN)).otherwise(head), F.lit(False)), part(escape(t), x["role"] == assistant)),
            )
        )
        return F.concat(texts, F.array(part(F.when(gone_on, F.lit("")).otherwise(F.lit(CLOSE)), F.lit(False))))

    segments = runs.select("conv_id", F.flatten(F.transform("r", pieces)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chats(formatted: Column) -> Column:
    """Read a formatted conversation back: array of ``(role, text)``, a struct per turn."""
    turns = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def parts(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = x.substr(F.length(role) + 2, F.length(x))
        return F.transform(F.split(body, r"<\+>"), lambda t: F.struct(_unescape_role(role.substr(F.lit(len(OPEN) + 1), F.length(role))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(turns, parts))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all conversations and conversation -7, read back from the output."""
    said = r"\### Assistant: </turn> ok"
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    out = format_chats(rows.unionByName(planted)).select(
        "conv_id",
        parse_chats(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
         length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS esc,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), chr(10), '')) AS esc_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(esc + CASE WHEN opens THEN 4 + esc_role + 1 + 8 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
