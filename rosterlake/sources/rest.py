"""A REST source read by offset and limit, one partition for each range of offsets.

`spark.dataSource.register(OffsetSource)`, then
`spark.read.format("offset").schema(...).option("pages", "module:function").load()`.
The function takes (offset, limit) and returns a list of dicts; it is imported
on the executors, so no connection is pickled.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class OffsetRange(InputPartition):
    def __init__(self, start: int, stop: int | None):
        super().__init__(start)
        self.start, self.stop = start, stop


class OffsetReader(DataSourceReader):
    """With a known total, ranges of `range` rows; without, one serial scan that ends at an empty page or one without new rows."""

    def __init__(self, names: list[str], options: dict[str, str]):
        self.names = names
        self.function = options["pages"]
        self.page = int(options.get("page_size", "100"))
        self.range = int(options.get("range", "10000"))
        self.total = int(options["total"]) if "total" in options else None
        self.key = options.get("key")

    def partitions(self) -> list[InputPartition]:
        if self.total is None:
            return [OffsetRange(0, None)]
        return [OffsetRange(a, min(a + self.range, self.total)) for a in range(0, self.total, self.range)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.function.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        at, seen = partition.start, set()
        while partition.stop is None or at < partition.stop:
            limit = self.page if partition.stop is None else min(self.page, partition.stop - at)
            rows = fetch(at, limit)
            fresh = [r for r in rows if not self.key or r.get(self.key) not in seen]
            if not rows or not fresh:
                return
            if self.key:
                seen.update(r.get(self.key) for r in fresh)
            yield from (tuple(r.get(n) for n in self.names) for r in fresh)
            at += len(rows)  # by what came, not by what was asked for


class OffsetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset"

    def reader(self, schema) -> DataSourceReader:
        return OffsetReader(schema.fieldNames(), dict(self.options))
