"""File sources and sinks: candidates, snapshots, logs, calendars."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightquay.functions.text import ics_escape, ics_fold

#: Telemetry rows: a closed list of fields.
TELEMETRY = "type string, ts long, client_id string, session_id string, locale string, event_id string, position int, ranking string, model_version string, viewport string, source string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_candidates(spark: SparkSession, paths: dict[str, str], schema: str | T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """JSON files of several sources under one schema, with ``source, source_rank, ordinal``.

    A missing file is empty unless required. A file with a malformed record is empty too,
    and named in a warning; a required one fails.
    """
    out = None
    for rank, (name, path) in enumerate(paths.items()):
        if not exists(spark, path):
            if name in required:
                raise FileNotFoundError(path)
            continue
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        if name not in required:
            try:
                df.write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001  whatever is wrong with the file, the others go on
                warnings.warn(f"{name} is left out: {str(e)[:120]}", stacklevel=2)
                continue
        df = df.select("*", F.lit(name).alias("source"), F.lit(rank).alias("source_rank"), F.monotonically_increasing_id().alias("ordinal"))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str, schema: str = TELEMETRY, strict: bool = True) -> DataFrame:
    """A JSON-lines log: strict reading fails on a bad line, else bad lines are kept in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def unknown_fields(spark: SparkSession, path: str, known: Sequence[str]) -> DataFrame:
    """``field, n`` of fields in a JSON-lines log that the schema does not have."""
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.filter(~F.col("field").isin(list(known))).groupBy("field").agg(F.count("*").alias("n"))


def read_snapshots(spark: SparkSession, folder: str, schema: str | T.StructType, last: int | None = None) -> DataFrame:
    """Snapshots partitioned by ``snapshot_ts`` under a superset schema; the last few are pruned by partition."""
    df = spark.read.schema(schema).option("basePath", folder).json(folder)
    if last is not None:
        recent = df.select("snapshot_ts").distinct().orderBy(F.desc("snapshot_ts")).limit(last)
        df = df.join(F.broadcast(recent), "snapshot_ts", "left_semi")
    return df


def write_snapshot(df: DataFrame, folder: str, snapshot_ts: str) -> None:
    """Overwrite one snapshot's partition; others stay as they are."""
    out = df.withColumn("snapshot_ts", F.lit(snapshot_ts))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts").json(folder)


def input_versions(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256, bytes`` of input files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))


def calendar_entries(events: DataFrame, uid: Column, title: Column, first: Column, after: Column, fold: bool = True) -> DataFrame:
    """``entry``: a VEVENT per row, content lines escaped and folded."""
    line = lambda name, value: F.concat(F.lit(f"{name}:"), value)
    lines = [line("UID", ics_escape(uid)), line("SUMMARY", ics_escape(title)), line("DTSTART;VALUE=DATE", F.date_format(first, "yyyyMMdd")), line("DTEND;VALUE=DATE", F.date_format(after, "yyyyMMdd"))]
    lines = [ics_fold(x) for x in lines] if fold else lines
    return events.withColumn("entry", F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), *lines, F.lit("END:VEVENT")))


def analytics_points(rows: DataFrame) -> DataFrame:
    """Telemetry rows as (indexes, blobs, doubles) points."""
    text = ["type", "session_id", "locale", "event_id", "ranking", "model_version", "viewport", "source"]
    return rows.select(F.array("client_id").alias("indexes"), F.array(*[F.coalesce(c, F.lit("")) for c in text]).alias("blobs"), F.array(F.col("ts").cast("double"), F.col("position").cast("double")).alias("doubles"))


def from_analytics(points: DataFrame) -> DataFrame:
    """Telemetry rows back from points."""
    text = ["type", "session_id", "locale", "event_id", "ranking", "model_version", "viewport", "source"]
    cols = [F.get("blobs", F.lit(i)).alias(c) for i, c in enumerate(text) if c != "model_version"]
    return points.select(F.get("indexes", F.lit(0)).alias("client_id"), *cols, F.nullif(F.get("blobs", F.lit(5)), F.lit("")).alias("model_version"), F.get("doubles", F.lit(0)).cast("long").alias("ts"), F.get("doubles", F.lit(1)).cast("int").alias("position"))


def export_rows(spark: SparkSession, path: str, from_ms: int, to_ms: int, schema: str = TELEMETRY) -> DataFrame:
    """Telemetry of a time range from a columnar store, in order of time: the closed list of columns and the range reach the scan."""
    columns = [c.split()[0] for c in schema.split(", ")]
    return spark.read.parquet(path).select(*columns).filter(F.col("ts").between(from_ms, to_ms - 1)).orderBy("ts", "client_id", "session_id", "position")
