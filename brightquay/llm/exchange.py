"""Helpers of exchanges: keys scrambled and cut into slices, numbers packed into binary cells."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from brightquay.llm.common import delete_path, shared_folder


_kept: list[Callable[[], None]] = []


def kept_by_worker(forget: Callable[[], None]) -> None:
    """Note that this worker keeps something between tasks, and how to put it away."""
    _kept.append(forget)


def fresh_worker() -> None:
    """Put away what tasks of other operators have left in this worker, and give free memory back."""
    while _kept:
        _kept.pop()()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def row_pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    """Inverse of :func:`packed`."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def slices_of(names: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Slices that have keys, and the places of each one's keys in ``names``; up to 2**32 slices."""
    at = ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return list(zip(at[cuts].tolist(), np.split(order, cuts[1:]), strict=True)) if len(at) else []


_tables: list[tuple[SparkSession, str, str]] = []


def bucketed(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``column`` in the shared folder, so that joins on it read it where it lies."""
    spark = df.sparkSession
    name = f"brightquay_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    _tables.append((spark, name, path))
    out = spark.table(name)
    out._brightquay_table = name
    return out


def drop_bucketed(table: DataFrame) -> None:
    """Delete a table of :func:`bucketed` that nothing reads any more."""
    for x in [x for x in _tables if x[1] == table._brightquay_table]:
        x[0].sql(f"DROP TABLE IF EXISTS {x[1]}")
        delete_path(x[0], x[2])
        _tables.remove(x)


@atexit.register
def _drop_tables() -> None:
    for spark, name, path in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
