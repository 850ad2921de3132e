"""Paged record services as a Spark data source: one partition for each range of pages.

Two dialects: ``offset`` ($limit and $offset in a stable order) and
``feature`` (resultOffset, with exceededTransferLimit telling of more). The option ``total`` says how many records there are; without it the reader
probes for the end, so an unknown number is still read by many tasks. How a page is fetched is given
by ``reader``, the dotted name of a function ``read(params) -> dict | list``, so tests need no network.
"""

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

ENVELOPES = ("features", "results", "items", "data")


def records_of(page) -> list[dict]:
    """The rows of a response: a list, or the list in its envelope."""
    if isinstance(page, list):
        return page
    return next((page[k] for k in ENVELOPES if isinstance(page.get(k), list)), [])


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.size = int(options.get("pageSize", "1000"))
        self.most = int(options["maxRecords"]) if "maxRecords" in options else None
        self.total = int(options["total"]) if "total" in options else None
        self.per_task = max(1, int(options.get("pagesPerTask", "50")))
        self.feature = options.get("dialect", "offset") == "feature"
        self.low, self.high = 0, self.most

    def _fetch(self, at: int, size: int):
        module, _, name = self.options["reader"].rpartition(".")
        where = self.options.get("where")
        params = {"resultOffset": at, "resultRecordCount": size, "where": where or "1=1"} if self.feature else {"$limit": size, "$offset": at, "$order": ":id", **({"$where": where} if where else {})}
        return getattr(importlib.import_module(module), name)(params)

    def _end(self) -> int:
        """A number of records that none lies behind, up to a page: where no total is given, single records are asked for at distances that double, then halve."""
        known = [x for x in (self.total, self.high) if x is not None]
        if self.total is not None or not records_of(self._fetch(self.low, 1)):
            return min(known, default=self.low) if self.total is not None else self.low
        there, step = self.low, self.size
        while (self.high is None or there + step < self.high) and records_of(self._fetch(there + step, 1)):
            there, step = there + step, 2 * step
        gone = there + step if self.high is None else min(self.high, there + step)
        while gone - there > self.size:
            middle = (there + gone) // 2
            there, gone = (middle, gone) if records_of(self._fetch(middle, 1)) else (there, middle)
        return gone

    def partitions(self) -> list[Pages]:
        """Ranges of pages over all records that the bounds leave."""
        first, last = self.low // self.size, -(-self._end() // self.size)
        return [Pages(k, min(k + self.per_task, last)) for k in range(first, last, self.per_task)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            at = page * self.size
            size = self.size if self.high is None else min(self.size, self.high - at)
            if size <= 0:
                return
            got = self._fetch(at, size)
            rows = records_of(got)
            for k, r in enumerate(rows):
                if at + k >= self.low:
                    yield at + k, json.dumps(r, sort_keys=True)
            more = bool(got.get("exceededTransferLimit")) if self.feature and isinstance(got, dict) else len(rows) == size
            if not rows or not more:
                return


class BoundedReader(PagedReader):
    """Conditions on ``ordinal`` become bounds of the pages that are fetched; others are left to Spark."""

    def pushFilters(self, filters):
        for f in filters:
            bounds = self._bounds(f) if getattr(f, "attribute", None) == ("ordinal",) else None
            if bounds is None:
                yield f
                continue
            low, high = bounds
            self.low = max(self.low, low or 0)
            self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    @staticmethod
    def _bounds(f) -> tuple[int | None, int | None] | None:
        """First ordinal, and the one behind the last."""
        if isinstance(f, EqualTo):
            return f.value, f.value + 1
        if isinstance(f, GreaterThanOrEqual | GreaterThan):
            return f.value + isinstance(f, GreaterThan), None
        if isinstance(f, LessThanOrEqual | LessThan):
            return None, f.value + isinstance(f, LessThanOrEqual)
        return (None, None) if isinstance(f, IsNotNull) else None


class PagedRecords(DataSource):
    """``spark.read.format("paged_records")``: rows (ordinal long, record string of JSON).

    With the option ``pushDown`` and ``spark.sql.python.filterPushdown.enabled``, conditions on ``ordinal`` reach the service.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "ordinal long, record string"

    def reader(self, schema) -> PagedReader:
        return (BoundedReader if self.options.get("pushDown", "false") == "true" else PagedReader)(self.options)
