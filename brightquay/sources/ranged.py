"""A store of rows by time, scanned by range: filters on time are pushed to it, and only the columns asked for are read.

Spark keeps pushed filters with the loaded frame, also for later queries on it: load anew
for every range.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class Slice(InputPartition):
    """Rows from one instant up to, and without, another."""

    def __init__(self, first: dt.datetime, last: dt.datetime):
        self.first, self.last = first, last


def _files(path: str) -> ds.Dataset:
    if "://" in path:
        store, at = pyarrow.fs.FileSystem.from_uri(path)
        return ds.dataset(at, filesystem=store, format="parquet")
    return ds.dataset(path, format="parquet")


class RangeReader(DataSourceReader):
    """Reads the slices of a time range; the range is what filters leave of it."""

    def __init__(self, options: dict, schema):  # noqa: ANN001
        self.path, self.column, self.slices = options["path"], options.get("time", "ts"), int(options.get("slices", 8))
        self.names = [f.name for f in schema.fields]
        self.low: dt.datetime | None = None
        self.high: dt.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Take the bounds on time; everything else stays with Spark."""
        for f in filters:
            mine = getattr(f, "attribute", None) == (self.column,) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
            if not mine:
                yield f
                continue
            at, tick = f.value.replace(tzinfo=None), dt.timedelta(microseconds=1)
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                low = at + tick if isinstance(f, GreaterThan) else at
                self.low = low if self.low is None else max(self.low, low)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = at if isinstance(f, LessThan) else at + tick
                self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[InputPartition]:
        """Slices of equal length between the bounds; where there is none, the files' own statistics give it."""
        low, high = self.low, self.high
        if low is None or high is None:
            first, last = self._extent()
            if first is None:
                return []
            low = first if low is None else low
            high = last + dt.timedelta(microseconds=1) if high is None else high
        if low >= high:
            return []
        step = (high - low) / self.slices
        cuts = [low + step * i for i in range(self.slices)] + [high]
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def _extent(self) -> tuple[dt.datetime | None, dt.datetime | None]:
        first = last = None
        for piece in _files(self.path).get_fragments():
            for group in piece.row_groups:
                s = (group.statistics or {}).get(self.column)
                if s:
                    first = s["min"] if first is None else min(first, s["min"])
                    last = s["max"] if last is None else max(last, s["max"])
        return first, last

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        """Batches of one slice: both the range and the columns reach the files. Where no slice was planned Spark asks for none."""
        if partition is None:
            return
        at = ds.field(self.column)
        yield from _files(self.path).to_batches(columns=self.names, filter=(at >= partition.first) & (at < partition.last))


class RangeSource(DataSource):
    """``spark.read.format("range").schema(columns).option("time", name).load(path)``: the schema names the columns that are read."""

    @classmethod
    def name(cls) -> str:
        """Format name."""
        return "range"

    def schema(self) -> str:
        """There is no default: what is not asked for is not read."""
        raise ValueError("give the columns to be read as a schema")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        """The reader."""
        return RangeReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RangeSource)
