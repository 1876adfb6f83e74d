"""Day models against single steps, and what stands on them: scores, shuffled labels, drafts, leaks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightquay.operators import descent, evaluate, graph, ranking, resolve
from brightquay.plans import chain

SHAPE = "event_id long, day long, features array<double>, label double, other double, weight double"


def training(n=400, seed=0, size=4):
    """Rows of six days, some with equal features."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, size)), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(2 - 4 * x[:, 0]))).astype(float)
    return x, y, rng.integers(0, 2, n).astype(float), rng.integers(1, 10, n).astype(float), rng.integers(0, 6, n)


def frame(spark, x, y, other, w, day):
    """As a DataFrame."""
    return spark.createDataFrame([(i, int(d), v.tolist(), float(a), float(b), float(c)) for i, (d, v, a, b, c) in enumerate(zip(day, x, y, other, w, strict=True))], SHAPE)


def test_day_models_equal_single_steps(spark):
    """Every day's model, under two labels, is what the descent on the rows before it gives step by step."""
    x, y, other, w, day = training()
    out = descent.fit_days(frame(spark, x, y, other, w, day), "day", labels=("label", "other"), least=60, steps=300).collect()
    days = sorted(d for d in set(day.tolist()) if (day < d).sum() >= 60)
    assert sorted({r.day for r in out}) == days and len(out) == 2 * len(days)
    for r in out:
        own = day < r.day
        assert r.n_before == own.sum()
        v, b = descent.step_by_step(x[own], (y if r.label == "label" else other)[own], w[own], steps=300)
        assert np.allclose(v, r.weights, atol=1e-7) and abs(b - r.bias) < 1e-7


def test_no_day_has_enough_rows(spark):
    """No rows, no models; a model of nothing is an error."""
    df = frame(spark, *training(20))
    assert descent.fit_days(df, "day", least=500).collect() == []
    assert descent.fit_days(df.limit(0), "day", least=0).collect() == []
    with pytest.raises(ValueError):
        descent.fit_all(df.limit(0))


def test_rounds_far_from_their_end_are_halved(spark):
    """A steep start takes short runs, and one step at a time if need be."""
    x, y, other, w, day = training(120, 3)
    x = x * 40
    r = descent.fit_days(frame(spark, x, y, other, w, day), "day", least=90, steps=40).collect()[-1]
    own = day < r.day
    v, b = descent.step_by_step(x[own], y[own], w[own], steps=40)
    assert np.allclose(v, r.weights, rtol=1e-6, atol=1e-6)


def test_scores_by_own_day(spark):
    """A row is scored by its day's model; days without one have no score."""
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "day long, features array<double>")
    models = spark.createDataFrame([("label", 1, 9, [3.0, 4.0], 0.5), ("other", 2, 9, [1.0, 1.0], 0.0)], "label string, day long, n_before long, weights array<double>, bias double")
    assert {r.day: r.z for r in evaluate.scored_by_day(rows, models, "day", "label", "z").collect()} == {1: 11.5, 2: None}


def test_shuffled_labels_keep_their_number(spark):
    """As many of each, on other rows; one row keeps its own."""
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") < 60).alias("label"))
    out = evaluate.shuffled_labels(df, "k", "label").collect()
    assert sum(r.shuffled for r in out) == 60 and 40 < sum(r.shuffled != r.label for r in out) < 130
    assert evaluate.shuffled_labels(df.limit(1), "k", "label").first().shuffled is True


def test_drafted_outcomes(spark):
    """Clicks on a team's items decide; clicks elsewhere and lists without the candidate don't count."""
    drafts = spark.createDataFrame([("a", 1, "candidate"), ("a", 2, "production"), ("b", 1, "candidate"), ("b", 2, "production"), ("c", 1, "production"), ("d", 1, "candidate"), ("d", 3, "candidate"), ("d", 2, "production")], "render string, item long, team string")
    clicked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 9)], "render string, item long")
    client = spark.createDataFrame([(r, f"client {r}") for r in "abcd"], "render string, client string")
    assert {r.render: r.value for r in evaluate.clustered_outcomes(drafts, clicked, client).collect()} == {"a": 1.0, "b": -1.0, "d": 0.0}


def test_perturbing_moves_what_may_not_be_read(spark):
    """Allowed fields stay, all others move, and the features don't see it."""
    p = spark.createDataFrame([(3, "n", "Brand#1", "PROMO", 7, 9.5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    q = chain.perturbed(p)
    assert q.first().p_name == "n-moved" and q.first().p_retailprice == 1243.5 and q.first().p_size == 7
    f = lambda d: d.select(chain.extracted(F.lit(1_700_000_000_000)).alias("f")).first().f
    assert f(p) == f(q) and len(f(p)) == 15


def test_components(spark):
    """Paths, cycles, loops, nulls and lone pairs."""
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (None, 1)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_crawl_keeps_reserves_and_budget(spark):
    """A reserve is a floor and no cap; the budget ends the crawl; what nothing links to is not visited."""
    links = spark.createDataFrame([("s", f"a{i}") for i in range(6)] + [("s", f"b{i}") for i in range(3)] + [("b0", "c"), ("a5", "s"), ("a0", "d")], "src string, dst string")
    pages = spark.createDataFrame([("s", "x", 9), *((f"a{i}", "x", 50 + i) for i in range(6)), *((f"b{i}", "y", i) for i in range(3)), ("c", "y", 1), ("d", None, None), ("lone", "y", 99)], "node string, region string, priority int")
    seeds, reserve = spark.createDataFrame([("s",)], "node string"), spark.createDataFrame([("y", 2)], "region string, pages int")
    got = [(r.node, r.depth) for r in graph.crawl(links, pages, seeds, 2, 6, reserve).orderBy("depth", "turn").collect()]
    assert got == [("s", 0), ("b2", 1), ("b1", 1), ("a5", 1), ("a4", 1), ("a3", 1)]
    every = {r.node for r in graph.crawl(links, pages, seeds, 5, 100, reserve).collect()}
    assert every == {"s", "c", "d"} | {f"a{i}" for i in range(6)} | {f"b{i}" for i in range(3)}


def test_component_fold_equals_the_fold_of_a_day(spark, monkeypatch):
    """Random records of few hosts, areas and words, with a hot host; the host's rows come in several batches."""
    import random

    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(240):
        w = sorted(rng.sample(words, rng.randint(2, 5)))
        hot = rng.random() < 0.4
        rows.append((i, f"day {rng.randint(0, 2)}" if rng.random() > 0.05 else None, "".join(w), w, "host" if hot else rng.choice(["", "h1", "h2", "h3"]), "sf" if hot else rng.choice(["", "sf", "oak"]), rng.randint(0, 9), rng.choice(["", "v"]), 1))
    r = spark.createDataFrame(rows, "ordinal int, day string, fingerprint string, words array<string>, host string, area string, confidence int, venue string, merged int")

    def merge(a, b):
        base, other = (b, a) if b["confidence"] > a["confidence"] else (a, b)
        return base | {"venue": base["venue"] or other["venue"], "ordinal": a["ordinal"], "merged": a["merged"] + b["merged"]}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        show = lambda df: sorted((x.ordinal, x.day, x.fingerprint, x.venue, x.merged) for x in df.collect() if x.day)
        apart = resolve.component_fold(r, resolve.match_links(r), resolve.same_event, merge)
        assert show(apart) == show(resolve.greedy_fold(r, resolve.same_event, merge))
        assert apart.filter("day IS NULL").count() == r.filter("day IS NULL").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chain_on_small_tables(spark):
    """A render shows an item once; features are fifteen; the prior clicks are those before."""
    import os

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables")
    s = chain.shown_parts(spark, data).persist()
    e = chain.log(spark, data).toPandas()
    assert s.groupBy("render", "item").count().filter("count > 1").count() == 0
    assert s.filter(F.size("features") != 15).count() == 0
    for r in s.orderBy(F.xxhash64("event_id")).limit(20).collect():
        assert r.prior == ((e["item"] == r.item) & e["label"] & (e["ms"] < r.ms)).sum()
    assert ranking.moved_features(s.select("event_id", "features"), s.select("event_id", "features"), "event_id").count() == 0


def test_a_dense_feature_keeps_few_cells(spark):
    """A feature with a value per row costs eight cells a bin, and the models stay those of single steps."""
    rng = np.random.default_rng(5)
    x, y, other, w, day = training(3000, 5, 2)
    x = np.column_stack([np.round(x[:, 0]), rng.random(3000) * 0.1])
    df = frame(spark, x, y, other, w, day)
    assert descent.weighted_cells(df, "day", "features", ["label"], "weight").count() == 3000
    assert descent.weighted_cells(df, "day", "features", ["label"], "weight", dense=1).count() <= 6 * 2 * 4 * 8
    r = descent.fit_days(df, "day", least=2000, steps=200, dense=1).collect()[-1]
    own = day < r.day
    v, b = descent.step_by_step(x[own], y[own], w[own], steps=200)
    assert np.allclose(v, r.weights, atol=1e-8) and abs(b - r.bias) < 1e-8


def test_bootstrap_makes_no_rows_of_picks(spark, monkeypatch):
    """Clients in several slices give what the generator's picks give one by one."""
    monkeypatch.setattr(ranking, "SLICE_CLIENTS", 7)
    df = spark.range(20).select(F.col("id").alias("c"), (F.col("id") * F.col("id") % 11).cast("double").alias("v"))
    out = ranking.bootstrap_mean(df, "c", "v", draws=90)
    assert "Range (0, 1800" not in out._jdf.queryExecution().optimizedPlan().toString()
    v = [r.v for r in sorted(ranking.numbered_keys(df, "c").collect(), key=lambda r: r.k)]
    rng = ranking.Mulberry(4242)
    means = sorted(sum(v[int(rng() * 20)] for _ in range(20)) / 20 for _ in range(90))
    r = out.first()
    assert (r.mean, r.low, r.high) == pytest.approx((sum(v) / 20, means[2], means[87]))
