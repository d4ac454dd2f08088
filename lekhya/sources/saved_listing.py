"""Saved listing pages as a data source, in batches or as a stream.

    register(spark)
    pages = spark.read.format("saved_listing").load("/shared/crawl/pages")
    items = listing.listed_items(pages, portal)

The path is a Parquet file, or a folder of them, with page_id, url and html.  A row group is a
partition and is read and parsed in small batches where it lies, so neither the driver nor a task
holds more than a few pages.  Comparisons of page_id and url skip row groups by their statistics
and are applied to the rows as well.  Pages with null columns are kept (no html: no rows or
links), repeated pages stay repeated, further columns of the files are not read, and a folder
without files has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo,
                                    Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    LessThan, LessThanOrEqual)

from lekhya.sources.listing import LINKS, ROWS, parsed

COLUMNS = ["page_id", "url", "html"]
BATCH = 64  # pages parsed at a time


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _files(fs: pafs.FileSystem, path: str) -> list[str]:
    """The data files of a path in the order of their names."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted(f.path for f in found if f.type == pafs.FileType.File
                  and not f.base_name.startswith(("_", ".")))


def _may_hold(test: Filter, low, high) -> bool:
    """Whether values from ``low`` to ``high`` can pass a comparison."""
    if isinstance(test, EqualTo):
        return low <= test.value <= high
    if isinstance(test, In):
        return any(v is not None and low <= v <= high for v in test.value)
    if isinstance(test, GreaterThan):
        return high > test.value
    if isinstance(test, GreaterThanOrEqual):
        return high >= test.value
    if isinstance(test, LessThan):
        return low < test.value
    if isinstance(test, LessThanOrEqual):
        return low <= test.value
    return True


def _row_groups(fs: pafs.FileSystem, files: list[str], tests: list[Filter]) -> list[RowGroup]:
    kept = []
    for path in files:
        with fs.open_input_file(path) as source:
            meta = pq.ParquetFile(source).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for group in range(meta.num_row_groups):
            def possible(test: Filter) -> bool:
                stats = meta.row_group(group).column(at[test.attribute[0]]).statistics
                return (stats is None or not stats.has_min_max
                        or _may_hold(test, stats.min, stats.max))
            if all(possible(t) for t in tests if t.attribute[0] in at):
                kept.append(RowGroup(path, group))
    return kept


def _read(root: str, part: RowGroup) -> Iterator[tuple]:
    fs, _ = _file_system(root)
    with fs.open_input_file(part.path) as source:
        for batch in pq.ParquetFile(source).iter_batches(
                BATCH, row_groups=[part.group], columns=COLUMNS):
            for page in batch.to_pylist():
                yield (page["page_id"], page["url"], *parsed(page["html"]))


class ListingReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            if isinstance(test, known) and test.attribute in (("page_id",), ("url",)):
                self.tests.append(test)
            yield test  # statistics only skip row groups, Spark filters the rows

    def partitions(self) -> list[RowGroup]:
        fs, path = _file_system(self.root)
        # one empty partition, as Spark hands None to read where there is none
        return _row_groups(fs, _files(fs, path), self.tests) or [RowGroup("", 0)]

    def read(self, partition: RowGroup) -> Iterator[tuple]:
        return _read(self.root, partition) if partition.path else iter(())


class ListingStream(DataSourceStreamReader):
    """New files in the order of their names; a file that arrives before the last one read is an
    error, as its pages would be lost."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"last": "", "files": 0}

    def latestOffset(self) -> dict:
        fs, path = _file_system(self.root)
        files = _files(fs, path)
        return {"last": files[-1], "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        fs, path = _file_system(self.root)
        files = [f for f in _files(fs, path) if f <= end["last"]]
        late = [f for f in files if f <= start["last"]]
        if len(late) > start["files"]:
            raise ValueError(f"{len(late) - start['files']} files arrived before {start['last']}; "
                             "names of new files have to ascend")
        return _row_groups(fs, [f for f in files if f > start["last"]], [])

    def read(self, partition: RowGroup) -> Iterator[tuple]:
        return _read(self.root, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class SavedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_listing"

    def schema(self) -> str:
        return f"page_id bigint, url string, rows {ROWS}, links {LINKS}"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedListing)
