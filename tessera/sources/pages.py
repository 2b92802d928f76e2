"""Stored pages as a data source that deals them by host, so that one task has all pages of its hosts and can keep its pace with each.

spark.read.format("portal_pages") reads them all; readStream takes ``batch`` page numbers at a time. Options: path (a Parquet file or
folder of page_id, url, html that every machine can open), groups (tasks).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HOST = re.compile(r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)")
SCHEMA = "page_id long, url string, html string, host string"


class HostGroup(InputPartition):
    """The hosts of one group, and the page numbers [start, end)."""

    def __init__(self, group: int, start: int | None = None, end: int | None = None):
        self.group, self.start, self.end = group, start, end


def host_of(url: str | None) -> str:
    """The address's host in lower case, empty without one."""
    met = HOST.match(url or "")
    return met[1].lower() if met else ""


def read_group(path: str, groups: int, part: HostGroup) -> Iterator[pa.RecordBatch]:
    """A group's pages. Addresses are read first, and the rest only of row groups that hold some of its pages."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    data = ds.dataset(path, format="parquet")
    ranged = None if part.start is None else (pc.field("page_id") >= part.start) & (pc.field("page_id") < part.end)
    for fragment in data.get_fragments(filter=ranged):
        for piece in fragment.split_by_row_group(filter=ranged):
            hosts = [host_of(u) for u in piece.to_table(columns=["url"], filter=ranged).column("url").to_pylist()]
            mine = [zlib.crc32(h.encode()) % groups == part.group for h in hosts]
            if not any(mine):
                continue
            rows = piece.to_table(columns=["page_id", "url", "html"], filter=ranged)
            picked = rows.append_column("host", pa.array(hosts, pa.string())).filter(pa.array(mine))
            yield from picked.combine_chunks().to_batches(max_chunksize=512)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.groups, self.batch = options.get("path"), int(options.get("groups", "8")), int(options.get("batch", "100"))
        if not self.path or self.groups < 1 or self.batch < 1:
            raise ValueError("portal_pages needs a path, and groups and batch of one or more")


class PageReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [HostGroup(k) for k in range(self.options.groups)]

    def read(self, partition: HostGroup) -> Iterator[pa.RecordBatch]:
        yield from read_group(self.options.path, self.options.groups, partition)


class PageStream(DataSourceStreamReader):
    """Offsets are page numbers; a batch brings the next ``batch`` of them."""

    def __init__(self, options: _Options):
        self.options, self.at = options, 0

    def _end(self) -> int:
        import pyarrow.dataset as ds

        known = (c.statistics for f in ds.dataset(self.options.path, format="parquet").get_fragments() for c in (f.metadata.row_group(k).column(f.metadata.schema.names.index("page_id")) for k in range(f.metadata.num_row_groups)))
        return max((s.max + 1 for s in known if s is not None and s.has_min_max), default=0)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.options.batch, max(self._end(), self.at))
        return {"page": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["page"])  # after a restart the numbers go on from the checkpoint's
        return [HostGroup(k, start["page"], end["page"]) for k in range(self.options.groups)]

    def read(self, partition: HostGroup) -> Iterator[pa.RecordBatch]:
        yield from read_group(self.options.path, self.options.groups, partition)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "portal_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return PageReader(_Options(dict(self.options)))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return PageStream(_Options(dict(self.options)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
