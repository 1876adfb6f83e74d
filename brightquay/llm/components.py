"""Connected components by alternating stars, on tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightquay.llm.common import drop_table, write_table


#: Edges that one task joins by itself; more are first thinned out in stars.
TASK_EDGES = 500_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node that each reaches: labels fall along edges and to the labels' labels."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        now = label.copy()
        for side in (x, y):
            np.minimum.at(now, side, low)
            np.minimum.at(now, label[side], low)
        now = now[now]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def _joined_in_tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = list(frames)
    if own:
        f = pd.concat(own)
        nodes, roots = _roots(f["a"].to_numpy(), f["b"].to_numpy())
        yield pd.DataFrame({"a": nodes, "b": roots})


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` edges, as a table: the least node reachable.

    Every task joins a bounded number of edges by itself and keeps one edge per node. As
    long as that takes several tasks, stars shrink what is left, in a number of rounds that
    grows with the logarithm of the graph; each round is written, and a giant component's
    hub is joined as an aggregated row. Loops and repeated edges do no harm; no edges, no
    rows.
    """
    now = write_table(edges.select("a", "b"), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        tasks = -(-mark[0] // TASK_EDGES)
        if tasks <= 1 or mark == before:
            break
        before = mark
        thin = now.repartition(tasks, "a", "b").mapInPandas(_joined_in_tasks, "a long, b long").filter("a <> b")
        after = write_table(_small_star(_large_star(thin)), "edges")
        drop_table(now)
        now = after
    whole = now.repartition(1).mapInPandas(_joined_in_tasks, "a long, b long") if tasks <= 1 else now.union(now.select("b", "b").distinct())
    out = write_table(whole.toDF("node", "component"), "components")
    drop_table(now)
    return out
