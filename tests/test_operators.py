"""Operators on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightquay.operators import descent, joins, ranking, resolve, rollups, snapshots, telemetry
from brightquay.sources import files, paged
from brightquay.streaming import telemetry as streams


def rows(df, *cols):
    """Sorted tuples."""
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_renders_reset_the_seen_set(spark):
    """Positions 0 1 0 1 and a silence: three lists."""
    x = spark.createDataFrame([("c", "s", t, p, f"e{i}") for i, (t, p) in enumerate([(0, 0), (1, 1), (2, 0), (3, 1), (60_003, 2)])], "client_id string, session_id string, ts long, position int, event_id string")
    assert rows(telemetry.renders(x), "render", F.size("items")) == [(1, 2), (2, 2), (3, 1)]


def test_asof_takes_equal_times_and_drops_orphans(spark):
    """At or before; nothing before, nothing out."""
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 4, 40)], "k int, t int, v int")
    assert rows(joins.asof(left, right, "k", "t", ["v"]), "x", "asof_v") == [("a", 50)]


def test_same_event_reasons(spark):
    """Containment, host, words, and what is not the same."""
    data = [
        (1, "d", "biopharmahackday", ["biopharma", "day", "hack"], "", "sf"),
        (2, "d", "biopharmahackdayataws", ["at", "aws", "biopharma", "day", "hack"], "", "oak"),
        (3, "d", "x", ["x"], "host", "sf"),
        (4, "d", "y", ["y"], "host", "sf"),
        (5, "d", "abcd", ["a", "b", "c", "d"], "", "sj"),
        (6, "d", "abcde", ["a", "b", "c", "d", "e"], "", "sj"),
        (7, "e", "biopharmahackday", ["biopharma", "day", "hack"], "", "sf"),
        (8, None, "biopharmahackday", ["biopharma"], "host", "sf"),
    ]
    r = spark.createDataFrame(data, "ordinal int, day string, fingerprint string, words array<string>, host string, area string")
    assert rows(resolve.first_matches(r), "ordinal", "root", "reason") == [(2, 1, "title"), (4, 3, "host"), (6, 5, "words")]


def test_greedy_fold_compares_merged_records(spark):
    """A merged record has taken the later one's name, so a third one matches it."""
    r = spark.createDataFrame([(1, "d", "a", 1), (2, "d", "ab", 1), (3, "d", "abc", 1), (4, None, "a", 1)], "ordinal int, day string, name string, n int")
    out = resolve.greedy_fold(r, lambda a, b: b["name"].startswith(a["name"]) and len(b["name"]) - len(a["name"]) <= 1, lambda a, b: a | {"name": b["name"], "n": a["n"] + b["n"]})
    assert rows(out, "ordinal", "name", "n") == [(1, "abc", 3), (4, "a", 1)]


def test_reconcile_states(spark):
    """Carried until the budget is used up; gone rows are removed."""
    p = spark.createDataFrame([(1, "a", 0), (2, "b", 3), (3, "c", 0), (4, "gone", 0)], "k int, v string, missed int")
    c = spark.createDataFrame([(1, "A"), (5, "e")], "k int, v string")
    out = snapshots.reconcile(p, c, "k", F.col("p.v") == "gone", 3)
    assert rows(out, "k", "state", "missed", "v") == [(1, "present", 0, "A"), (2, "removed", 4, "b"), (3, "carried", 1, "c"), (4, "removed", 1, "gone"), (5, "added", 0, "e")]


def test_collapse_stops_a_publication():
    """Half of the baseline, but 12 at least."""
    snapshots.check_collapse(0, 0)
    snapshots.check_collapse(20, 12)
    with pytest.raises(RuntimeError):
        snapshots.check_collapse(100, 49)


def test_clicks_descend(spark):
    """A feature that goes with clicks gets a positive weight, and the model is accepted by its names."""
    x = spark.createDataFrame([([1.0], 1.0, 1.0), ([0.0], 0.0, 1.0), ([1.0], 1.0, 2.0), ([0.0], 1.0, 0.5)], "features array<double>, label double, weight double")
    m = ranking.fit_clicks(x, steps=300)
    near = ranking.fit_clicks(x, steps=5)
    f = x.toPandas()
    far, bias = descent.step_by_step(np.stack(f["features"]), f["label"].to_numpy(), f["weight"].to_numpy(), steps=5)
    assert m.weights[0] > 0 and m.acceptable(["a"], ["a"]) and not m.acceptable(["b"], ["a"])
    assert abs(far[0] - near.weights[0]) < 1e-9 and abs(bias - near.bias) < 1e-9


def test_bootstrap_brackets_the_mean(spark):
    """The interval holds the mean."""
    x = spark.createDataFrame([(f"c{i}", float(i % 3)) for i in range(60)], "client string, v double")
    r = ranking.bootstrap_mean(x, "client", "v", draws=200).first()
    assert r.low < r.mean < r.high


def test_health_rules(spark):
    """A stale, throttled and empty source."""
    s = spark.createDataFrame([("a", 0, 3, 0, "HTTP 429")], "source string, n int, floor int, last_ms long, error string")
    out = rollups.health_rules(s, F.lit(200_000_000_000)).filter("fired")
    assert rows(out, "rule") == [("below floor",), ("empty",), ("stale",), ("throttled",)]


def test_log_reading(spark, tmp_path):
    """Strict reading fails on a bad line, loose reading keeps it; unknown fields are named."""
    p = tmp_path / "log.jsonl"
    p.write_text('{"type":"click","ts":1,"extra":2}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        files.read_log(spark, str(p)).collect()
    loose = files.read_log(spark, str(p), strict=False).cache()
    assert loose.filter("_corrupt_record IS NOT NULL").count() == 1
    assert rows(files.unknown_fields(spark, str(p), ["type", "ts"]), "field", "n") == [("extra", 1)]


def test_points_go_there_and_back(spark):
    """Rows to points and back."""
    r = spark.createDataFrame([("click", 5, "c", "s", "en", "e", 3, "none", None, "wide", "web")], files.TELEMETRY)
    back = files.from_analytics(files.analytics_points(r))
    assert back.select(*r.columns).collect() == r.collect()


def test_paged_source_stops_at_the_cursor(spark, tmp_path):
    """Pages until one has no next."""
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [{"id": i}], "next": "x" if i < 2 else None}))
    paged.register(spark)
    assert spark.read.format("paged").load(str(tmp_path)).count() == 3


def test_snapshots_are_overwritten_one_by_one(spark, tmp_path):
    """Writing a snapshot again leaves the others."""
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for ts in ("1", "2", "2"):
        files.write_snapshot(df, str(tmp_path / "s"), ts)
    got = files.read_snapshots(spark, str(tmp_path / "s"), "k int, v string, snapshot_ts string")
    assert rows(got, "snapshot_ts", "k") == [("1", 1), ("2", 1)]
    assert files.read_snapshots(spark, str(tmp_path / "s"), "k int, v string, snapshot_ts string", last=1).count() == 1


def test_stream_of_telemetry(spark, tmp_path):
    """A file stream is validated, freed of repeats and appended."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    line = {"type": "impression", "ts": 1_700_000_000_000, "client_id": "c" * 16, "session_id": "s" * 16, "locale": "en", "event_id": "e", "position": 0, "ranking": "none", "model_version": None, "viewport": "wide", "source": "web"}
    (src / "a.json").write_text("\n".join(json.dumps(x) for x in (line, line, line | {"type": "bad"})))
    reason = telemetry.telemetry_reason(F.lit(1_800_000_000_000), {"type": ["impression", "click"]})
    s = streams.once_per_list(streams.with_event_time(streams.valid_rows(spark.readStream.schema(files.TELEMETRY).json(str(src)), reason)))
    q = s.writeStream.foreachBatch(streams.append_once(str(out))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 1


def test_matches_read_records_that_were_written_once(spark):
    """What records are made of is not in the plan of their matches, however many kinds there are."""
    rows = [(1, "d", "springhackathon", ["a"], "h", "x"), (2, "d", "myspringhackathon", ["b"], "H-", "x"), (3, "d", "other", ["c"], "h", "x")]
    r = spark.createDataFrame(rows, "ordinal long, day string, fingerprint string, words array<string>, host string, area string").withColumn("host", F.regexp_replace(F.lower("host"), "-", ""))
    m = resolve.first_matches(r)
    assert "regexp_replace" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, m.collect())) == [(2, 1, "title"), (3, 1, "host")]
    assert "regexp_replace" not in resolve.match_links(r)._jdf.queryExecution().optimizedPlan().toString()


def test_containment_broadcasts_nothing(spark):
    """Keys and texts grow with the input, so neither goes to the driver, however small files make them look."""
    texts = spark.range(50).select(F.concat(F.lit("a text with key number "), F.col("id").cast("string")).alias("t"))
    out = joins.contains_join(texts, "t", texts.select(F.substring("t", 8, 20).alias("k")), "k", 12)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString() and out.count() == 50
    board = texts.select(F.col("t").alias("id"), F.lit(None).cast("string").alias("slug"), F.col("t").alias("key"))
    assert "Broadcast" not in joins.slug_or_key_join(board, board)._jdf.queryExecution().sparkPlan().toString()
