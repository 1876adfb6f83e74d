"""Hard-negative mining over a pivot table.

Largest inner products are nearest neighbours once vectors are augmented: with M the
largest squared length, a row y becomes (y, sqrt(M - |y|^2)) and an anchor a becomes (a, 0),
so that their squared distance is |a|^2 + M - 2 <a, y>. Every row's distances to a few
pivots are stored with it. By the triangle inequality an anchor's own distances to the
pivots then bracket each of its scores, and only rows whose bracket reaches the best ones
found so far, or the wanted range, are scored exactly.

Anchors and rows are dealt to blocks of bounded size; a task holds one block of each. A
label of any share of the rows is split in the same way, and what blocks return is at
most the wanted number per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightquay.llm.common import load, write_table

#: Pivots, and rows by smallest hash among which they are chosen; any choice gives the same result.
PIVOTS, PIVOT_SAMPLE = 12, 1000
#: Rows and anchors of a block at most, rows of a block at least, and anchors bracketed at a time.
ROW_BLOCK, ANCHOR_BLOCK, LEAST_BLOCK, CHUNK = 16_384, 8_192, 512, 64
#: Widening of brackets, in units of |a|^2 + M, far above the rounding of doubles.
SLACK = 1e-9
#: Up to here sums of products of whole doubles are exact.
EXACT = 2.0**53


def usable(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, label, q``: rows with a label and whole finite vectors, components as floor(256 x)."""
    x = embeddings.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return x.filter(F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).select(
        "vec_id", "label", F.transform("x", lambda v: F.floor(v * 256).cast("double")).alias("q")
    )


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of a matrix; missing components are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with as many columns."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors to augmented pivots."""
    x, p = _widened(x, pivots)
    gap = np.stack([((x - q) ** 2).sum(1) for q in p], 1) + (last[:, None] - heights[None, :]) ** 2
    return np.sqrt(gap)


def _heights(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def choose_pivots(sample: np.ndarray, most: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a sample that lie far from each other, each the farthest from those before it."""
    heights = _heights(sample, most)
    at = [0] if len(sample) else []
    near = np.full(len(sample), np.inf)
    while at and len(at) < n:
        near = np.minimum(near, _distances(sample, heights, sample[at[-1:]], heights[at[-1:]])[:, 0])
        if near.max() == 0:
            break
        at.append(int(near.argmax()))
    return sample[at], heights[at]


def pivot_table(rows: DataFrame, most: float, pivots: np.ndarray, heights: np.ndarray) -> DataFrame:
    """``rows`` numbered in ``row``, with ``far``, the distances to the pivots, as a stored table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("q"))
                far = _distances(x, _heights(x, most), pivots, heights)
                cells = pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1], far.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "far"])

    return write_table(rows.mapInArrow(add, "vec_id long, label long, q array<double>, far array<double>").withColumn("row", F.monotonically_increasing_id()), "pivots")


class _Block:
    """Anchors and rows that meet: brackets of all scores, exact scores where asked."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, most: float, pivots: np.ndarray, heights: np.ndarray):
        self.a, self.y = _widened(_matrix(anchors["q"]), _matrix(rows["q"]))
        self.far, self.most, self.pivots, self.heights = _matrix(rows["far"], len(heights)), most, pivots, heights
        self.ids = [x.to_numpy(zero_copy_only=False) for x in (rows["vec_id"].combine_chunks().fill_null(0), rows["row"].combine_chunks())]
        self.no_id = rows["vec_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        self.anchor_rows, self.labels, self.anchor_labels = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for t, c in ((anchors, "row"), (rows, "label"), (anchors, "label")))
        bound = np.sqrt((self.a**2).sum(1).max(initial=0)) * np.sqrt((self.y**2).sum(1).max(initial=0))
        self.exact = bound < EXACT

    def brackets(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor: what its scores are at least and at most."""
        square = (self.a**2).sum(1) + self.most
        for start in range(0, len(self.a), CHUNK):
            a = self.a[start : start + CHUNK]
            mine = _distances(a, np.zeros(len(a)), self.pivots, self.heights)
            near, far = np.zeros((len(a), len(self.y))), np.full((len(a), len(self.y)), np.inf)
            for j in range(mine.shape[1]):
                theirs = self.far[:, j]
                np.maximum(near, np.abs(mine[:, j, None] - theirs), out=near)
                np.minimum(far, mine[:, j, None] + theirs, out=far)
            whole = square[start : start + CHUNK, None]
            least, most = (whole - far**2) / 2 - SLACK * whole - 1, (whole - near**2) / 2 + SLACK * whole + 1
            for i in range(len(a)):
                yield start + i, least[i], most[i]

    def scores(self, i: int, at: np.ndarray) -> np.ndarray:
        """Exact inner products of one anchor with some rows."""
        if self.exact:
            return (self.y[at] @ self.a[i]).astype(np.int64)
        a = [int(v) for v in self.a[i]]
        return np.array([sum(p * int(v) for p, v in zip(a, y, strict=True)) for y in self.y[at]], dtype=np.int64)  # beyond 64 bits: an OverflowError

    def best(self, at: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places in ``at`` of the n first by score, id and row."""
        ids, rows = self.ids
        return np.lexsort((rows[at], ids[at], self.no_id[at], -scores))[:n]


def _nth(x: np.ndarray, n: int) -> float:
    """The n-th largest; without so many, nothing is excluded."""
    return np.partition(x, len(x) - n)[len(x) - n] if len(x) >= n else -np.inf


def _sized(blocks: float | Column, n: int) -> Column:
    return F.greatest(F.ceil(blocks / F.lit(n)), F.lit(1))


def _meet(anchors: DataFrame, rows: DataFrame, on: list[str], n_a: Column, n_r: Column, work, schema: str) -> DataFrame:
    """Deal both sides to blocks, and let every block of anchors meet every block of rows, by the columns of ``on``."""
    a = anchors.withColumn("block_a", F.pmod(F.xxhash64("row"), n_a).cast("long")).withColumn("block_r", F.explode(F.sequence(F.lit(0).cast("long"), (n_r - 1).cast("long"))))
    r = rows.withColumn("block_r", F.pmod(F.xxhash64("row"), n_r).cast("long")).withColumn("block_a", F.explode(F.sequence(F.lit(0).cast("long"), (n_a - 1).cast("long"))))
    keys = [*on, "block_a", "block_r"]
    a, r = a.toDF(*a.columns), r.toDF(*r.columns)  # both may come from one table
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(work, schema)


def mine_hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows of :func:`usable`.

    ``anchor`` is a condition that says which rows are anchors. Positives are an anchor's
    first rows of its label, itself left out; negatives of a positive are the first rows of
    other labels that satisfy low * positive <= 100 * score <= high * positive. First are
    larger scores, then smaller ids, then rows without an id, then rows of one id in any
    order. Repeated rows count each by itself. Vectors of different lengths are filled up
    with zeros, so an empty one scores 0. An anchor without other rows of its label, or
    none in range, returns nothing. Products beyond 2^53 are summed as whole numbers, beyond 2^63
    the query ends with an error.
    """
    spark = rows.sparkSession
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v))).first()
    sample = [r.q for r in rows.select("q", F.xxhash64("vec_id", "q").alias("h")).orderBy("h", "q").limit(PIVOT_SAMPLE).collect()]
    pivots, heights = choose_pivots(_matrix(pa.array(sample, pa.list_(pa.float64()))), most or 0.0, PIVOTS)
    most = float(most or 0.0)
    table = pivot_table(rows, most, pivots, heights)
    size = min(ROW_BLOCK, max(LEAST_BLOCK, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    anchors = table.filter(anchor).select("row", "vec_id", "label", "q")
    per_label = write_table(table.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(anchor).alias("n_anchors")).filter("n_anchors > 0"), "labels")
    n_anchors = per_label.agg(F.sum("n_anchors")).first()[0] or 0

    def first_positives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = _Block(left, right, most, pivots, heights)
            for i, least, upper in block.brackets():
                other = block.ids[1] != block.anchor_rows[i]
                at = np.flatnonzero(other & (upper >= _nth(least[other], positives)))
                score = block.scores(i, at)
                k = block.best(at, score, positives)
                out += [(block.anchor_rows[i], block.ids[1][at[j]], None if block.no_id[at[j]] else block.ids[0][at[j]], score[j]) for j in k]
        return _columns(out, ("anchor", "positive", "positive_id", "positive_score"))

    n_r, n_a = _sized(F.col("n_rows"), size), _sized(F.col("n_anchors"), ANCHOR_BLOCK)
    met = _meet(anchors.join(per_label, "label"), table.join(per_label, "label"), ["label"], n_a, n_r, first_positives, "anchor long, positive long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive"))
    found = write_table(met.withColumn("place", place).filter(F.col("place") <= positives), "positives")

    def in_range(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = _Block(left, right, most, pivots, heights)
            wanted = left["wanted"].to_pylist()
            for i, least, upper in block.brackets():
                other, near = block.labels != block.anchor_labels[i], np.zeros(len(upper), bool)
                for w in wanted[i]:
                    bottom, top = low * w["positive_score"] / 100, high * w["positive_score"] / 100
                    sure = other & (least >= bottom) & (upper <= top)
                    near |= other & (least <= top) & (upper >= max(bottom, _nth(least[sure], negatives)))
                at = np.flatnonzero(near)
                score = block.scores(i, at)
                for w in wanted[i]:
                    p = w["positive_score"]
                    inside = np.flatnonzero(_between(score, p, low, high))
                    for j in inside[block.best(at[inside], score[inside], negatives)]:
                        out.append((block.anchor_rows[i], w["positive"], block.ids[1][at[j]], None if block.no_id[at[j]] else block.ids[0][at[j]], score[j]))
        return _columns(out, ("anchor", "positive", "negative", "negative_id", "negative_score"))

    lists = found.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score")).alias("wanted"))
    asked = anchors.join(lists, anchors["row"] == lists["anchor"]).drop("anchor")
    met = _meet(asked, table, [], _sized(F.lit(n_anchors), ANCHOR_BLOCK), _sized(F.lit(n), size), in_range, "anchor long, positive long, negative long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative"))
    chosen = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = chosen.join(found.select("anchor", "positive", "positive_id", "positive_score").toDF("anchor", "positive", "positive_id", "positive_score"), ["anchor", "positive"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _between(scores: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive in whole numbers of any size."""
    least, most = -(-low * positive // 100), high * positive // 100
    return (scores >= least) & (scores <= most)


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({name: pa.array([None if r[k] is None else int(r[k]) for r in rows], pa.int64()) for k, name in enumerate(names)})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of 30 to 90 per cent of each positive's score, for anchors whose id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(usable(load(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH rows_ AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
