"""Shared helpers of the training-data operators.

Tables that cut lineage are written as Parquet under the folder that the cluster
names in ``spark.checkpoint.dir``; a local folder is made only where that is unset and
driver and executors are one process (tests, notebooks).
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightquay.session import ship_package

#: ASCII white space of every contract: space and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: A word, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by the worker.
BATCH_ROWS = 2000

_made: list[tuple[SparkSession, str]] = []


def _small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS where they are at Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; any path that Spark's readers open will do."""
    ship_package(spark)
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; without one, an error on anything but a single machine."""
    _small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table through Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by ``partition_by``, and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brightquay-{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._brightquay_path = path
    return out


#: Files of a table up to which their numbers are broadcast to the rows: 16 MB at most.
MOST_FILES = 100_000


def free_name(docs: DataFrame, base: str) -> str:
    """``base``, with as many underscores behind it as it takes for ``docs`` to have no such column, in any case."""
    taken = {c.lower() for c in docs.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` and ``row``, a number of the row that every reading agrees on; the name must be free.

    A table read from files keeps their order: its rows are numbered by file and place in
    it, and nothing is written. Anything else, and a table of more than MOST_FILES files, is
    written with its numbers.
    """
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        path, place, file, number = (free_name(docs, f"_bq_{x}") for x in ("path", "place", "file", "number"))
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
        files = placed.select(path).distinct()
        files = write_table(files.select(F.col(path).alias(file), (F.row_number().over(W.orderBy(path)) - 1).cast("long").alias(number)), "files")
        if files.count() <= MOST_FILES:
            rows = placed.join(F.broadcast(files), F.col(path) == F.col(file))
            return rows.select(*docs.columns, (F.shiftleft(number, 40) + F.col(place)).alias(row))
    return write_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


class Scratch:
    """Tables that are written within go at its end, but for those kept."""

    def __enter__(self) -> Scratch:
        self.before, self.kept = {path for _, path in _made}, set()
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        """``table`` stays."""
        self.kept.add(table._brightquay_path)
        return table

    def __exit__(self, *_: object) -> None:
        gone = [x for x in _made if x[1] not in self.before | self.kept]
        for spark, path in gone:
            delete_path(spark, path)
        _made[:] = [x for x in _made if x not in gone]


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of :func:`write_table` that nothing reads any more."""
    gone = {df._brightquay_path for df in tables}
    for path in gone:
        delete_path(tables[0].sparkSession, path)
    _made[:] = [x for x in _made if x[1] not in gone]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when each query ends, and not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@atexit.register
def _sweep() -> None:
    """Intermediate tables live as long as the session that made them."""
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
