"""Streaming rules, exports and candidate files."""

import json

import pytest
from pyspark.sql import functions as F

from brightquay.sources import files
from brightquay.streaming import telemetry


def test_swept_records_keep_their_misses(spark, tmp_path):
    """Misses add up over batches, a find resets them, and the budget removes."""
    schema, folder = "url string, sweep long, found boolean", tmp_path / "in"
    batches = [[("a", 1, True), ("b", 1, False)], [("a", 2, False), ("b", 2, False), ("b", 3, False)], [("a", 3, True), ("b", 4, False)]]
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    for i, b in enumerate(batches):
        at = folder / f"{i}.json"
        at.write_text("\n".join(json.dumps(dict(zip(("url", "sweep", "found"), r, strict=True))) for r in b))
        query = telemetry.swept_records(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r.url, r.sweep): (r.state, r.missed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): ("present", 0), ("b", 1): ("carried", 1), ("a", 2): ("carried", 1), ("b", 2): ("carried", 2), ("b", 3): ("carried", 3), ("a", 3): ("present", 0), ("b", 4): ("removed", 4)}


def test_times_of_telemetry(spark):
    """Clock, retention, identity periods and batches."""
    day = 86_400_000
    df = spark.createDataFrame([("a", 0), ("a", 8 * day), ("a", 6 * day), ("b", 100 * day)], "client string, ts long")
    assert telemetry.within_retention(df, "ts", F.lit(100 * day)).count() == 1
    assert sorted((r.client, r.p) for r in df.select("client", telemetry.identity_period("client", "ts").alias("p")).collect()) == [("a", 0), ("a", 0), ("a", 1), ("b", 0)]
    assert [r.batch for r in telemetry.in_batches(df.filter("client = 'a'"), "client", "ts", 2).orderBy("ts").collect()] == [0, 0, 1]
    now = 1_700_000_000_000
    got = spark.range(1).select(*[telemetry.clock_reason(F.lit(t).cast("long"), F.lit(now)) for t in (5, now + 700_000, now + 500_000)]).first()
    assert tuple(got) == ("old", "future", None)


def test_exports_and_candidates(spark, tmp_path):
    """A range of time and the closed columns alone; a malformed file is left out with a warning, a required one fails."""
    row = {"type": "click", "ts": 5, "client_id": "c", "session_id": "s", "locale": "en", "event_id": "e", "position": 1, "ranking": "r", "model_version": None, "viewport": "v", "source": "web", "more": 1}
    spark.createDataFrame([tuple(row.values()), tuple((row | {"ts": 9}).values())], files.TELEMETRY + ", more int").write.parquet(str(tmp_path / "log"))
    out = files.export_rows(spark, str(tmp_path / "log"), 0, 9)
    assert out.count() == 1 and "more" not in out.columns
    (tmp_path / "a.json").write_text('[{"url": "u"}]')
    (tmp_path / "b.json").write_text('[{"url": ')
    paths = {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "b.json"), "c": str(tmp_path / "none.json")}
    with pytest.warns(UserWarning, match="b is left out"):
        assert [(r.url, r.source) for r in files.read_candidates(spark, paths, "url string").collect()] == [("u", "a")]
    with pytest.raises(Exception):
        files.read_candidates(spark, paths, "url string", required=("b",)).collect()
