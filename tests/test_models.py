"""Model artifacts, versions, tombstone files and places in an order."""

import json

import pytest
from pyspark.sql import functions as F

from brightquay.operators import evaluate, publish, ranking


def test_accepted(spark):
    """Anything but the expected names, finite weights, a finite bias and a version is refused."""
    good = {"feature_names": ["a", "b"], "weights": [1, -0.5], "bias": 0, "model_version": "v"}
    wrong = [{"feature_names": ["b", "a"]}, {"feature_names": ["a"]}, {"weights": [1]}, {"weights": [1, None]}, {"weights": [1, "NaN"]}, {"weights": [1, "x"]}, {"weights": None}, {"bias": None}, {"bias": "Infinity"}, {"model_version": ""}, {"model_version": None}, {"feature_names": None}]
    texts = [json.dumps(good), *(json.dumps(good | w) for w in wrong), '{"feature_names": ["a",', "[]", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("ok", ranking.accepted(ranking.model_of(F.col("t")), ["a", "b"]))
    assert [r.ok for r in df.orderBy("i").collect()] == [True] + [False] * (len(texts) - 1)


def test_versions_agree(spark):
    """The column is the function of one model; a log's hash is of a multiset."""
    args = (["a", "b"], {"rate": 0.05, "steps": 20}, 1.0, 10.0)
    df = spark.createDataFrame([(5, "x", 0), (6, "y", 2)], "n long, log string, web long").withColumn("v", evaluate.version_of(*args, F.col("n"), F.col("log"), F.col("web")))
    assert all(r.v == evaluate.model_version(*args, r.n, r.log, r.web) for r in df.collect())
    h = lambda rows: spark.createDataFrame([(x,) for x in rows], "t string").agg(evaluate.rows_sha256(F.col("t"))).first()[0]
    assert h("abca") == h("caab") and len({h("abc"), h("abca"), h("ab")}) == 3


def test_tombstones_come_back(spark, tmp_path):
    """Every tombstone is in one file and read back; none at all is an empty list; one torn file of many stops all."""
    stones = spark.range(2500).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("delete").alias("action"))
    publish.write_tombstones(stones, f"{tmp_path}/t", per_file=100)
    back = publish.read_tombstones(spark, f"{tmp_path}/t")
    assert sorted(r.url for r in back.collect()) == sorted(f"u{i}" for i in range(2500))
    publish.write_tombstones(stones.limit(0), f"{tmp_path}/empty")
    assert publish.read_tombstones(spark, f"{tmp_path}/empty").count() == 0
    (tmp_path / "t" / "part-torn.json").write_text('{"tombstones": [{"url"')
    with pytest.raises(ValueError, match="no list"):
        publish.read_tombstones(spark, f"{tmp_path}/t").collect()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_placed(spark, n):
    """Places are those of a sort, ties in the order of what comes next."""
    df = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("score")).repartition(7)
    got = {r.id: r.place for r in ranking.placed(df, F.desc("score"), F.asc("id")).collect()}
    rows = sorted(df.collect(), key=lambda r: (-r.score, r.id))
    assert got == {r.id: i + 1 for i, r in enumerate(rows)}
