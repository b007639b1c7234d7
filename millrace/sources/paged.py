"""Listings that are served page by page, as a data source for batches and for streams.

A listing has a declared total and pages of one size whose rows are in a stable order. Where that
order is by a key, predicates on the key become a range of pages: its ends are sought by halving, with one page
asked for at each step. The range is cut into parts of equal numbers of pages, read in as many tasks; a part ends at its
first short page (the total was declared before rows went) or, in a listing with the newest first, after some pages in a
row without a row that is still open.

As a stream, the offset is the declared total: it moves from one batch to the next only when all pages of a
batch were read and kept. A total that has not changed makes no batch. Each batch reads again the rows just before it
(``overlap``), as listings are corrected near their end, so rows come at least once and a sink has to take rows by key.
With ``availableNow`` a start makes one batch: after a failure that is the failed one again, and what has come since is read by the next start.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

NAME = "paged"
#: Pages that one task reads, and the pages without an open row after which it stops.
PAGES_A_TASK = 64
STALE_PAGES = 3
DECLARED = "declared"


class FolderListing:
    """A listing kept in a folder: ``page=<n>`` with JSON lines, and ``declared`` with total and size."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path)

    def _lines(self, folder: str) -> Iterator[dict]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        for file in sorted(f.path for f in found if f.base_name.endswith(".json")):
            with self.store.open_input_stream(file) as data:
                yield from map(json.loads, data.read().decode().splitlines())

    def declared(self) -> tuple[int, int]:
        """The number of rows and the rows of a page. A listing that grew has several; the largest total holds."""
        return max(((d["total"], d["size"]) for d in self._lines(DECLARED)), default=(0, 1))

    def page(self, number: int) -> list[dict]:
        """The rows of a page; none beyond the last."""
        return list(self._lines(f"page={number}"))


def listing_of(options: dict) -> FolderListing:
    """The listing named by the option ``listing`` (``module:class``), made with the path."""
    name = options.get("listing")
    if not name:
        return FolderListing(options["path"])
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)(options["path"])


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``end`` (exclusive) of ``size`` rows, and of them the rows at places ``skip`` to
    ``until`` of the listing. What was learned while planning is here, as readers are sent off before."""

    first: int
    end: int
    skip: int
    until: int
    size: int


def parts(skip: int, until: int, size: int, pages: int) -> list[Pages]:
    """The pages that hold rows ``skip`` to ``until``, some for each task; without rows, one part without pages."""
    first, end = skip // size, -(-until // size)
    return [Pages(n, min(n + pages, end), skip, until, size) for n in range(first, end, pages)] or [Pages(0, 0, 0, 0, size)]


class Bounds:
    """What predicates on the key leave: least and greatest value, each with whether it is itself meant."""

    def __init__(self):
        self.low = self.high = None

    def narrow(self, column: Filter) -> None:
        """``column`` on the key. Only narrower bounds replace what is there."""
        v = column.value
        if isinstance(column, In):
            least, most = (min(v), max(v)) if v else (None, None)
        else:
            least = v if isinstance(column, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
            most = v if isinstance(column, (EqualTo, LessThan, LessThanOrEqual)) else None
        if least is not None:
            self.low = least if self.low is None else max(self.low, least)
        if most is not None:
            self.high = most if self.high is None else min(self.high, most)


def first_page(pages: int, last_key: Callable[[int], object], beyond: Callable[[object], bool]) -> int:
    """The first of ``pages`` whose last key is ``beyond`` a bound, by halving. A page without rows is
    taken as beyond: it lies after all that have some."""
    low, high = 0, pages
    while low < high:
        middle = (low + high) // 2
        key = last_key(middle)
        if key is None or beyond(key):
            high = middle
        else:
            low = middle + 1
    return low


class _Rows:
    """Rows of a part of the listing, as tuples of the schema's columns."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)

    def rows(self, part: Pages, stale: Callable[[dict], bool] | None = None) -> Iterator[tuple]:
        listing, empty = listing_of(self.options), 0
        for number in range(part.first, part.end):
            found = listing.page(number)
            kept = [r for k, r in enumerate(found, number * part.size) if part.skip <= k < part.until and not (stale and stale(r))]
            yield from (tuple(r.get(n) for n in self.names) for r in kept)
            empty = 0 if kept else empty + 1
            if len(found) < part.size or (stale and empty >= STALE_PAGES):
                return


class PagedReader(DataSourceReader, _Rows):
    def __init__(self, schema: StructType, options: dict):
        _Rows.__init__(self, schema, options)
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the key narrow the range of pages; Spark still filters rows, as pages are whole."""
        key = self.options.get("key")
        for f in filters:
            if key and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute == (key,):
                self.bounds.narrow(f)
            yield f

    def partitions(self) -> list[Pages]:
        listing = listing_of(self.options)
        total, size = listing.declared()
        key, low, high = self.options.get("key"), self.bounds.low, self.bounds.high
        first, end = 0, -(-total // size)
        seen: dict[int, object] = {}

        def last(number: int):
            if number not in seen:
                found = listing.page(number)
                seen[number] = found[-1][key] if found else None
            return seen[number]

        if low is not None:
            first = first_page(end, last, lambda k: k >= low)
        if high is not None:
            end = min(end, first_page(end, last, lambda k: k > high) + 1)
        return parts(first * size, min(total, end * size), size, int(self.options.get("pagesatask", PAGES_A_TASK)))

    def read(self, partition: Pages) -> Iterator[tuple]:
        column, before = self.options.get("stalecolumn"), self.options.get("stalebefore")
        stale = (lambda r: r.get(column) is not None and str(r[column]) < before) if column else None
        yield from self.rows(partition, stale)


class PagedStreamReader(DataSourceStreamReader, _Rows):
    def __init__(self, schema: StructType, options: dict):
        _Rows.__init__(self, schema, options)
        self.overlap = int(self.options.get("overlap", 0))

    def initialOffset(self) -> dict:
        return {"total": 0}

    def latestOffset(self) -> dict:
        return {"total": listing_of(self.options).declared()[0]}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        # a listing that shrank is read again where it ends
        _, size = listing_of(self.options).declared()
        skip = max(0, min(start["total"], end["total"]) - self.overlap)
        pages = int(self.options.get("pagesatask", PAGES_A_TASK))
        return parts(skip, end["total"], size, pages)

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.read.format("paged")`` or ``readStream``, with a schema of its own. Options: ``path``; ``key``, by
    which rows are sorted; ``pagesATask``; ``staleColumn`` and ``staleBefore`` (texts of one form, such as days): rows before
    it are left out, and a part ends after STALE_PAGES pages of nothing else; ``overlap``; ``listing``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, {k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_listing(df: DataFrame, path: str, order: str, size: int, after: int = 0) -> int:
    """Writes ``df`` in the order of the unique column ``order`` as pages of ``size`` rows behind the ``after`` rows that
    are there, and returns the total. Rows are numbered by their place in a range and the ranges' counts,
    so no task sees all of them."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_at": at, "_range": F.spark_partition_id()})
    ranged.write.mode("overwrite").parquet(f"{path}-ranges")
    ranged = spark.read.parquet(f"{path}-ranges")
    total, starts = after, []
    # one count for each range of the exchange
    for name, n, least in sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.count("*"), F.min("_at")).collect()):
        starts.append((name, total - least))
        total += n
    if starts:
        starts = spark.createDataFrame(starts, "_range int, _start long")
        placed = ranged.join(F.broadcast(starts), "_range").withColumn("_place", F.col("_at") + F.col("_start"))
        placed = placed.withColumn("page", F.floor(F.col("_place") / size))
        placed = placed.repartition("page").sortWithinPartitions("page", "_place").drop("_at", "_range", "_start", "_place")
        placed.write.mode("append").option("ignoreNullFields", False).partitionBy("page").json(path)
    declared = spark.createDataFrame([(total, size)], "total long, size long").coalesce(1)
    declared.write.mode("append").json(f"{path}/{DECLARED}")
    return total
