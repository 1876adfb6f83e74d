"""Hard negatives against brute force, with edges."""

import math
import random

from pyspark.sql import functions as F

from brightquay.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, q string"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """All pairs in plain Python; rows are (id, vector, label)."""
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, v, lab) in enumerate(ok):
        if not anchor(i):
            continue
        scored = [(dot(v, w), j, m) for n, (j, w, m) in enumerate(ok) if n != k]
        for p, pid, _ in sorted((s for s in scored if s[2] == lab), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != lab and low * p <= 100 * s[0] <= high * p), key=order)[:negatives]
            out += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    """The operator's rows."""
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA)
    return sorted((tuple(r) for r in hn.mine_hard_negatives(hn.usable(df), F.col("vec_id") % 10 == 0, **options).collect()), key=str)


def test_brute_force_with_ties_and_hot_label(spark, monkeypatch):
    """Small integers tie often; half of the rows have one label; blocks are small."""
    monkeypatch.setattr(hn, "LEAST_BLOCK", 16)
    monkeypatch.setattr(hn, "ROW_BLOCK", 40)
    rng = random.Random(3)
    rows = [(i, [rng.randint(-2, 6) / 256 for _ in range(5)], 0 if rng.random() < 0.5 else rng.randint(1, 4)) for i in range(300)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    """Nulls and infinities take no part; lengths differ; ids are null or repeat; lone labels and negative scores return nothing."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [2.0, 1.0, 5.0], 1), (3, [], 2), (4, [0.5, 0.5], 2), (None, [0.75, 0.5], 2), (5, None, 1), (6, [1.0, None], 1), (7, [nan], 1), (8, [inf], 2), (9, [1.0, 1.0], None)]
    rows += [(10, [-1.0, -2.0], 3), (20, [1.0, 0.0], 3), (30, [1.0, 1.0], 4), (11, [0.25, 1.0], 2), (12, [0.25, 1.0], 2)]
    got = mined(spark, rows)
    assert got and got == brute(rows, lambda i: i is not None and i % 10 == 0)
    assert {r[0] for r in got} == {0}
    assert any(r[3] is None for r in got)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_repeated_rows_count_by_themselves(spark):
    """Two rows of one id are two anchors, and each other's positive."""
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.0], 2)]
    assert mined(spark, rows) == [(0, 0, 1, 1, 65536, 32768)] * 2


def test_scores_beyond_doubles_are_exact(spark):
    """Products over 2^53 are summed as whole numbers."""
    big = float(2**21)
    rows = [(0, [big, 1.0, 1 / 256], 1), (1, [big, 1.0, 1 / 256], 1), (2, [big / 2, 1.0, 1 / 256], 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_brackets_hold(spark):
    """No exact score lies outside its bracket."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    y, a = np.floor(rng.normal(size=(200, 8)) * 256), np.floor(rng.normal(size=(5, 8)) * 256)
    most = float((y**2).sum(1).max())
    pivots, heights = hn.choose_pivots(y[:50], most, 6)
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    table = lambda m, **more: pa.table({"q": lists(m), "row": np.arange(len(m)), "vec_id": np.arange(len(m)), "label": np.zeros(len(m), int)} | more)
    block = hn._Block(table(a), table(y, far=lists(hn._distances(y, hn._heights(y, most), pivots, heights))), most, pivots, heights)
    narrow = 0
    for i, least, upper in block.brackets():
        score = y @ a[i]
        assert (least <= score).all() and (score <= upper).all()
        narrow += (upper - least).mean()
    assert narrow > 0
