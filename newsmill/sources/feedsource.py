"""Feed files as a data source: ``spark.read.format("feed")`` and ``spark.readStream.format("feed")``.

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").load("hdfs://…/feeds")

A row an entry: feed (the file's name without its ending), url, title, published_at, image_url, well_formed. Files that
end in .xml, .rss or .atom (or what the option ``endings`` lists) count, in all folders below the path; a feed that is no XML gives the entries
that a tolerant reader finds, one without entries gives none.

Files are listed through the file system that the path names (local, HDFS, S3 …) and dealt to partitions of about
``partition_bytes``. A stream takes files in the order of (time of change, path); its offset is the last file of a batch,
at most ``max_files`` after the one before, so a restart reads on where the checkpoint ends. A file that is changed
later counts as a new one; files younger than ``settle_seconds`` wait, so that none of the same time comes too late.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsmill.functions.feedxml import entries

ENDINGS = (".xml", ".rss", ".atom")
SCHEMA = "feed string, url string, title string, published_at timestamp, image_url string, well_formed boolean"
ARROW = pa.schema([("feed", pa.string()), ("url", pa.string()), ("title", pa.string()), ("published_at", pa.timestamp("us", "UTC")), ("image_url", pa.string()), ("well_formed", pa.bool_())])


@dataclass
class Files(InputPartition):
    """Paths that a task reads."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class _Reader:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 16 << 20))
        self.max_files = int(options.get("max_files", 1000))
        self.endings = tuple(options.get("endings", ",".join(ENDINGS)).split(","))
        self.settle_seconds = float(options.get("settle_seconds", 0))

    def files(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes) in order."""
        system, root = _place(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if system.get_file_info(root).type != fs.FileType.File else [system.get_file_info(root)]
        return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.endings))

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out, held, size = [], [], 0
        for _, path, n in files:
            held.append(path)
            size += n
            if size >= self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
        return [*out, *([Files(held)] if held else [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                found, well = entries(stream.read())
            name = PurePosixPath(path).stem
            if found:
                yield pa.RecordBatch.from_pylist([{"feed": name, "well_formed": well, **e} for e in found], ARROW)


class FeedReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.files()) or [Files([])]


class FeedStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the time and path of the last file that was taken."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.reached: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        start = self.reached or self.initialOffset()
        until = time.time_ns() - int(self.settle_seconds * 1e9)
        new = [f for f in self.files() if (f[0], f[1]) > (start["time"], start["path"]) and f[0] <= until][: self.max_files]
        self.reached = {"time": new[-1][0], "path": new[-1][1]} if new else start
        return self.reached

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.reached = max(end, self.reached or end, key=lambda o: (o["time"], o["path"]))  # after a restart the checkpoint tells where to go on
        return self.dealt([f for f in self.files() if (start["time"], start["path"]) < (f[0], f[1]) <= (end["time"], end["path"])])

    def commit(self, end: dict) -> None:
        self.reached = max(end, self.reached or end, key=lambda o: (o["time"], o["path"]))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))
