"""Session helpers: the package's own code on the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions load anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "brightquay.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names, deleted when the session's process ends; without the setting, a local folder where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/brightquay-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read back: what it was made of is not run again, and plans of rounds don't nest."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._brightquay_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    gone = {t._brightquay_path for t in tables}
    for path in gone:
        _delete(tables[0].sparkSession, path)
    _made[:] = [x for x in _made if x[1] not in gone]
