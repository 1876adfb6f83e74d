"""Day models: full-batch gradient descent for all days at once, many steps in a pass.

A model of a day is trained on the rows of all days before it. The steps of a descent
follow each other, but whole runs of them can be reckoned together: guess the next m points
of a path, take the gradients at all of them in one distributed pass, and solve the path's
recurrence with the curvature frozen; repeat until the points stop moving. What remains
then is the path that single steps would have taken, to the tolerance. All models share
every pass: it sums, over the rows, a gradient for each pair of model and step, and a row
counts for the models of later days only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and points that a task reckons at a time: the largest arrays are their product.
CELL_ROWS, POINTS = 1024, 4096
#: Steps of the first run and of the longest one, and the passes after which even a run of one step has ended.
FIRST_RUN, LONGEST_RUN, MOST_PASSES = 6, 512, 60
#: Width of a dense feature's bins, and the places in one, in units of it, that stand for its rows: Chebyshev's, with both ends.
BIN, NODES = 1 / 32, tuple((1 - np.cos(np.pi * np.arange(8) / 7)) / 2)


def weighted_cells(rows: DataFrame, day: str, features: str, labels: Sequence[str], weight: str, dense: int | None = None) -> DataFrame:
    """``day, x, w, y0, y1, ...``: rows with equal day and features as one, with their weight and each label's weighted sum.

    ``dense`` is the place of a feature that takes about as many values as there are rows.
    Rows of a day that differ only there, within a bin, are handed to eight fixed places in
    it by the weights of the polynomial through these. What a descent sums over rows is
    smooth, so it stays the same but for rounding: with weights of the feature below 20 by
    less than 1e-10 of it. So there are eight cells a bin at most, however many rows.
    """
    at = F.col(features)
    keys, shares = [F.col(day).cast("long").alias("day"), at.alias("x")], [F.lit(1.0)]
    if dense is not None:
        t = F.get(at, F.lit(dense)) / BIN
        keys = [keys[0], F.transform(at, lambda v, i: F.when(i == dense, F.floor(t) * BIN).otherwise(v)).alias("x")]
        shares = [_share(t - F.floor(t), j) for j in range(len(NODES))]
    sums = [F.sum(F.col(weight).cast("double") * share).alias(f"w_{j}") for j, share in enumerate(shares)]
    sums += [F.sum(F.col(c).cast("double") * F.col(weight) * share).alias(f"y{i}_{j}") for i, c in enumerate(labels) for j, share in enumerate(shares)]
    cells, names = rows.groupBy(*keys).agg(*sums), ["w", *(f"y{i}" for i in range(len(labels)))]
    if dense is None:
        return cells.select("day", "x", *[F.col(f"{n}_0").alias(n) for n in names])
    moved = lambda by: F.transform("x", lambda v, i: F.when(i == dense, v + by).otherwise(v))
    placed = F.array(*[F.struct(moved(float(u * BIN)).alias("x"), *[F.col(f"{n}_{j}").alias(n) for n in names]) for j, u in enumerate(NODES)])
    return cells.select("day", F.explode(placed).alias("_c")).select("day", "_c.*").filter(" OR ".join(f"{n} <> 0" for n in names))


def _share(u: Column, j: int) -> Column:
    """The polynomial that is 1 at node ``j`` and 0 at the others."""
    out = F.lit(1.0)
    for i, node in enumerate(NODES):
        if i != j:
            out = out * ((u - float(node)) / float(NODES[j] - node))
    return out


def _summed(cells: DataFrame, days: np.ndarray, label_of: np.ndarray, points: np.ndarray, curved: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Gradients at ``points`` (models, steps, size), and with ``curved`` the Hessians at each model's first and last point."""
    models, steps, size = points.shape
    sent = cells.sparkSession.sparkContext.broadcast(points)  # models times steps times size numbers, whatever the rows
    upper = np.triu_indices(size)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = sent.value
        gradient, hessian = np.zeros((models, steps, size)), np.zeros((models, 2, len(upper[0])))
        seen = False
        for f in frames:
            for start in range(0, len(f), CELL_ROWS):
                g = f.iloc[start : start + CELL_ROWS]
                x = np.column_stack([np.stack(g["x"].to_numpy()), np.ones(len(g))])
                w, day = g["w"].to_numpy(), g["day"].to_numpy()
                seen = True
                for m in range(models):
                    own = day < days[m]
                    if not own.any():
                        continue
                    xm, wm, ym = x[own], w[own], g[f"y{label_of[m]}"].to_numpy()[own]
                    for s in range(0, steps, POINTS):
                        p = 1 / (1 + np.exp(-(xm @ at[m, s : s + POINTS].T)))
                        gradient[m, s : s + POINTS] += (wm[:, None] * p - ym[:, None]).T @ xm
                        for end, at_step in enumerate((0, steps - 1)) if curved else ():
                            if s <= at_step < s + POINTS:
                                q = p[:, at_step - s]
                                hessian[m, end] += ((xm * (wm * q * (1 - q))[:, None]).T @ xm)[upper]
        if seen:
            own = np.concatenate([gradient.reshape(models, -1), hessian.reshape(models, -1)], axis=1) if curved else gradient.reshape(models, -1)
            yield pd.DataFrame({"model": np.arange(models), "sums": [row.tobytes() for row in own]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        """One model's sums of all tasks."""
        whole = np.sum([np.frombuffer(b) for b in parts["sums"]], axis=0)
        return pd.DataFrame({"model": parts["model"].iloc[:1], "sums": [whole.tobytes()]})

    rows = cells.mapInPandas(part, "model long, sums binary").groupBy("model").applyInPandas(add, "model long, sums binary").collect()  # a row per model
    sent.unpersist()
    out = np.zeros((models, steps * size + 2 * len(upper[0]) * curved))
    for r in rows:
        out[r.model] = np.frombuffer(r.sums)
    hessians = None
    if curved:
        hessians = np.zeros((models, 2, size, size))
        hessians[:, :, upper[0], upper[1]] = hessians[:, :, upper[1], upper[0]] = out[:, steps * size :].reshape(models, 2, -1)
    return out[:, : steps * size].reshape(points.shape), hessians


def descend(cells: DataFrame, days: np.ndarray, label_of: np.ndarray, total: np.ndarray, rate: float, steps: int, l2: float, tolerance: float) -> np.ndarray:
    """Weights, with the bias last, of a model per entry of ``days`` after ``steps`` steps; ``cells`` are cached and let go of at the end."""
    size = len(cells.select("x").first()[0]) + 1
    penalty = np.append(np.full(size - 1, l2), 0.0)

    def moved(w: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """Where one step from ``w`` leads."""
        return w - rate * (gradient / total[:, None, None] + penalty * w)

    at, done, run = np.zeros((len(days), size)), 0, FIRST_RUN
    last = np.zeros_like(at)
    ends = np.broadcast_to(np.diag(1 - rate * penalty), (2, len(days), size, size))

    def jump(t: int, over: int) -> np.ndarray:
        """How a step changes with its point, between the run's first and last one."""
        share = t / max(over - 1, 1)
        return (1 - share) * ends[0] + share * ends[1]

    try:
        while done < steps:
            run = min(run, steps - done)
            path, delta = np.empty((len(days), run + 1, size)), last
            path[:, 0] = at
            for t in range(run):  # the guess: steps change as the curvature said last
                delta = np.einsum("mij,mj->mi", ends[1], delta)
                path[:, t + 1] = path[:, t] + delta
            for passes in range(1, MOST_PASSES + 1):
                gradient, hessian = _summed(cells, days, label_of, path[:, :run], curved=passes in (1, 3))
                if hessian is not None:
                    ends, over = np.moveaxis(np.eye(size) - rate * (hessian / total[:, None, None, None] + np.diag(penalty)), 1, 0), run
                step, fresh = moved(path[:, :run], gradient), path.copy()
                for t in range(run):
                    fresh[:, t + 1] = step[:, t] + np.einsum("mij,mj->mi", jump(t, over), fresh[:, t] - path[:, t])
                change, path = np.abs(fresh - path).max(), fresh
                if run == 1 or change <= tolerance or not np.isfinite(change):
                    break
                if passes % 6 == 0:  # too far at once: the first steps are nearer to their end
                    run = max(1, run // 2)
                    path = path[:, : run + 1]
            last, at, done = path[:, run] - path[:, run - 1], path[:, run].copy(), done + run
            run = min(run * 2 if passes <= 5 else max(run, 2), LONGEST_RUN)
    finally:
        cells.unpersist()
    return at


def fit_days(
    rows: DataFrame, day: str, features: str = "features", labels: Sequence[str] = ("label",), weight: str = "weight", least: int = 200, rate: float = 0.5, steps: int = 2000, l2: float = 0.01, tolerance: float = 1e-8,
    dense: int | None = None,
) -> DataFrame:
    """``label, day, n_before, weights, bias`` of the model of every day that has ``least`` rows before it.

    Weights are after ``steps`` full-batch steps from zero on the weighted log-loss, the
    bias without penalty, as one step after another would leave them (to ``tolerance``).
    With several ``labels`` each gets its models in the same passes. Days are few: their
    models are what the driver holds. ``dense`` is that of :func:`weighted_cells`.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(F.col(day).cast("long").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("double")).alias("w")).toPandas().sort_values("day")
    before, mass = sizes["n"].cumsum() - sizes["n"], sizes["w"].cumsum() - sizes["w"]
    kept = (before >= least) & (before > 0) & (mass > 0)
    schema = "label string, day long, n_before long, weights array<double>, bias double"
    if not kept.any():
        return spark.createDataFrame([], schema)
    days, n_before = np.tile(sizes["day"][kept], len(labels)), np.tile(before[kept], len(labels))
    total, label_of = np.tile(mass[kept], len(labels)).astype(float), np.repeat(np.arange(len(labels)), kept.sum())
    cells = weighted_cells(rows, day, features, labels, weight, dense).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "day", "x").persist()
    at = descend(cells, days, label_of, total, rate, steps, l2, tolerance)
    out = [(labels[k], int(d), int(n), w[:-1].tolist(), float(w[-1])) for k, d, n, w in zip(label_of, days, n_before, at, strict=True)]
    return spark.createDataFrame(out, schema)


def fit_all(rows: DataFrame, features: str = "features", label: str = "label", weight: str = "weight", rate: float = 0.5, steps: int = 2000, l2: float = 0.01, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Weights and bias of one model on all rows: :func:`fit_days` with a single day."""
    cells = weighted_cells(rows.withColumn("_day", F.lit(0)), "_day", features, [label], weight).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x").persist()
    total = cells.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("no rows with weight to train on")
    w = descend(cells, np.ones(1), np.zeros(1, dtype=int), np.array([total]), rate, steps, l2, tolerance)[0]
    return w[:-1], float(w[-1])


def step_by_step(x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float = 0.5, steps: int = 2000, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """The same descent on arrays, one step after another: what tests hold :func:`fit_days` against."""
    v, b, total = np.zeros(x.shape[1]), 0.0, w.sum()
    for _ in range(steps):
        e = w * (1 / (1 + np.exp(-(x @ v + b))) - y)
        v, b = v - rate * (x.T @ e / total + l2 * v), b - rate * e.sum() / total
    return v, float(b)
