"""Quality classifier on random Fourier features of document statistics.

One scan turns every text into a short vector of statistics, kept as a table. Random
Fourier features approximate a Gaussian kernel over the standardised statistics. The
normal equations of ridge regression are summed per partition and then per matrix row;
the driver sees the summed matrix alone, whose size is fixed. Isotonic calibration pools
a histogram of raw scores, whose number of bins is fixed too, of learning rows that the
ridge has not been fitted on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import fold_of, load, text_of, write_table
from brightquay.llm.exchange import fresh_worker

#: Random features, kernel width in standard deviations, ridge penalty, bins of the calibration, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 3.0, 1e-3, 1024, 7
_STATS = 18


def document_stats(text: str) -> list[float]:
    """Statistics of one whole text; an empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    h = np.bincount(raw, minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, ln = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    upper, lower, digit = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    punct = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        (n - h[32] - h[10]) / w if words else 0.0,
        upper / n,
        upper / max(upper + lower, 1),
        digit / n,
        punct / n,
        (h[44] + h[46]) / n,
        (punct - h[44] - h[46]) / n,
        h[33] / w,
        h[124] / w,
        h[128:].sum() / n,
        h[:32].sum() / n,
        len(counts) / w,
        same / w,
        max(counts.values(), default=0) / w,
        len(set(lines)) / ln,
    ]


def stats_table(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            x = np.array([document_stats(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, _STATS)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * _STATS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(of, f"doc_id {kind}, stats array<double>")


@dataclass
class QualityModel:
    """A fitted model; every part has a size fixed by the parameters."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([phi, np.ones((len(phi), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores before calibration."""
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def pool_adjacent(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) fit of weighted means by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for k, m in zip(n, mean, strict=True):
        blocks.append([m, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, k2, c2 = blocks.pop()
            m1, k1, c1 = blocks.pop()
            blocks.append([(m1 * k1 + m2 * k2) / (k1 + k2), k1 + k2, c1 + c2])
    return np.array([m for m, _, c in blocks for _ in range(int(c))])


def fit_quality(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> QualityModel:
    """Fit on ``stats, y, calibrate`` rows; without rows every score is 0.5.

    Rows marked ``calibrate`` fit the isotonic step and the others the ridge; where either
    kind is missing, all rows do both. With rows of one label only, scores are near that
    label.
    """
    kinds = rows.agg(F.count_if("calibrate").alias("some"), F.count_if(~F.col("calibrate")).alias("others")).first()
    apart = kinds.some > 0 and kinds.others > 0
    fitted, checked = (rows.filter("NOT calibrate"), rows.filter("calibrate")) if apart else (rows, rows)
    rng = np.random.default_rng(seed)
    directions, phases = rng.standard_normal((_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features)
    at = F.posexplode("stats").alias("k", "v")
    moments = fitted.select(at).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        flat = np.zeros(_STATS)
        return QualityModel(flat, flat + 1, directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean, scale = np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments])
    model = QualityModel(mean, scale, directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    size = features + 1

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((size, size + 2))
        for f in frames:
            if len(f):
                phi = model.features(np.stack(f["stats"].to_numpy()))
                y = f["y"].to_numpy(np.float64)
                a += np.hstack([phi.T @ phi, (phi.T @ y)[:, None], np.full((size, 1), len(y))])
        if a[0, -1]:
            yield pd.DataFrame({"i": range(size), "task": TaskContext.get().partitionId(), "v": list(a)})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [f["i"].iloc[0]], "v": [np.stack(f.sort_values("task")["v"].to_numpy()).sum(axis=0)]})

    sums = fitted.select("stats", "y").mapInPandas(part, "i int, task int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").toPandas()
    a = np.stack(sums.sort_values("i")["v"].to_numpy())
    penalty = ridge * a[0, -1] * np.eye(size)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(a[:, :size] + penalty + 1e-9 * np.eye(size), a[:, size])

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s = model.raw(np.stack(f["stats"].to_numpy()))
                yield pd.DataFrame({"bin": np.floor(np.clip((s + 0.5) / 2, 0, 1) * bins).astype(np.int64), "y": f["y"].to_numpy(np.float64)})

    hist = checked.select("stats", "y").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").toPandas()
    model.knots = (hist["bin"].to_numpy(np.float64) + 0.5) / bins * 2 - 0.5
    model.levels = pool_adjacent(hist["n"].to_numpy(np.float64), hist["y"].to_numpy(np.float64))
    return model


def quality_scores(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of a table of :func:`stats_table`."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["stats"].to_numpy()) if len(f) else np.zeros((0, _STATS))
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": model.score(x)})

    return stats.mapInPandas(of, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def label_means(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` of labels that have both; several labels of an id are averaged."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))


def model_of(stats: DataFrame, y: DataFrame, folds: int, held_out_fold: int) -> QualityModel:
    """The model fitted on labelled ``doc_id, stats`` rows outside the held-out fold of the id's crc32."""
    learn = stats.join(y, "doc_id").filter(fold_of(F.col("doc_id"), folds) != held_out_fold)
    apart = F.crc32(F.concat_ws(":", F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    return fit_quality(write_table(learn.select("stats", "y", apart.alias("calibrate")), "quality-rows"))


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from labelled rows outside the held-out fold of the id's crc32; labels without
    a value or a document are passed over, several labels of an id are averaged. Null
    texts are empty. Repeated rows get equal scores; a null id is never labelled and is
    returned with its score. Empty table, empty result; further columns are ignored.
    """
    stats = write_table(stats_table(docs), "quality-stats")
    scored = quality_scores(stats, model_of(stats, label_means(labels), folds, held_out_fold))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """Rows that the classifier of :func:`classify_quality` accepts, all their columns unchanged.

    Rows outside the held-out fold are reduced to their statistics, which then meet the
    labels, so no text is shuffled to fit the model; then one scan scores every row and
    lets it pass or not, whatever its id.
    """
    learnable = docs.filter(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out_fold))
    model = model_of(stats_table(learnable), label_means(labels), folds, held_out_fold)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            x = np.array([document_stats(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, _STATS)
            yield batch.filter(pa.array(model.score(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(of, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return classify_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
