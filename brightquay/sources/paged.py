"""A paged source: numbered page files read in parallel, with the stop rules of paged interfaces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Tasks that read the pages of a stated total at most: beyond, a task reads several.
MOST_TASKS = 1024


class PageFile(InputPartition):
    """One page with what is on it, where planning had to read it; or ``count`` pages from a number on."""

    def __init__(self, folder: str, first: int, items: list | None = None, count: int = 1):
        self.folder, self.first, self.items, self.count = folder, first, items, count


def read_page(path: str, tries: int = 2) -> dict | None:
    """A page from any file system that the path names, null where there is none; a failed reading is tried once more."""
    store, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    for left in range(tries - 1, -1, -1):
        try:
            if store.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
                return None
            with store.open_input_stream(at) as f:
                return json.loads(f.read())
        except OSError:
            if not left:
                raise
    return None


class PagedReader(DataSourceReader):
    """Reads pages ``0.json``, ``1.json``, ... of a folder: objects with ``items`` and perhaps ``next`` and ``total``."""

    def __init__(self, options: dict):
        self.folder, self.most, self.quiet = options["path"], float(options.get("pages", "inf")), int(options.get("quiet", 0))

    def partitions(self) -> list[InputPartition]:
        """Pages up to the stated total, the first without a cursor, a run of pages with nothing open, or the option ``pages``, where it is given.

        A first page that states a ``total`` and carries no cursor says how many pages there
        are: the others are left to the tasks, which read them in parallel. Cursors and
        quiet runs are only known from the page before, so those pages are read here, and
        what was read goes with the partition: no page is read twice.
        """
        out: list[InputPartition] = []
        n = calm = 0
        while len(out) < self.most:
            page = read_page(f"{self.folder}/{len(out)}.json")
            if page is None:
                break
            items = page["items"]
            out.append(PageFile(self.folder, len(out), items))
            n += len(items)
            if len(out) == 1 and items and "total" in page and "next" not in page and not self.quiet:
                pages = int(min(self.most, -(-page["total"] // len(items))))
                run = max(1, -(-pages // MOST_TASKS))
                return out + [PageFile(self.folder, i, count=min(run, pages - i)) for i in range(1, pages, run)]
            calm = 0 if any(x.get("open", True) for x in items) else calm + 1
            if ("next" in page and not page["next"]) or n >= page.get("total", float("inf")) or (self.quiet and calm >= self.quiet):
                break
        return out

    def read(self, partition: PageFile | None) -> Iterator[tuple]:
        """Items of a page as JSON text; a page that is not there any more has none. Where no page was planned Spark asks for none."""
        if partition is None:
            return
        for n in range(partition.first, partition.first + partition.count):
            path = f"{partition.folder}/{n}.json"
            items = partition.items if partition.items is not None else (read_page(path) or {"items": []})["items"]
            for i, item in enumerate(items):
                yield path, i, json.dumps(item, sort_keys=True)


class PagedSource(DataSource):
    """``spark.read.format("paged").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        """Format name."""
        return "paged"

    def schema(self) -> str:
        """Page, place on it and the item."""
        return "page string, place int, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        """The reader."""
        return PagedReader(self.options)


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as the files that :class:`PagedReader` reads, from ``page, body`` rows; written side by side, then named one by one, as pages are few."""
    spark = pages.sparkSession
    pages.repartition("page").write.partitionBy("page").text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/page=*/part-*")):
        n = part.getPath().getParent().getName().split("=")[1]
        store.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.json"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PagedSource)
