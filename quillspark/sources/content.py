"""Content providers as Spark data sources: files of a folder, as a table or as a stream, in partitions of bounded bytes."""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "provider string, item_type string, item_id string, path string, filename string, extension string, size_bytes long, modified_at timestamp, content binary"
#: Default of the option partitionBytes; options reach a source with names in lower case.
PARTITION_BYTES = 64 << 20


@dataclass
class Item:
    path: str
    size: int
    stamp: int  # nanoseconds


@dataclass
class Part(InputPartition):
    items: list


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def listed(options: dict) -> list[Item]:
    """The folder's files with the wanted extensions, also those without a byte; hidden names are left out."""
    from pyarrow import fs

    system, root = filesystem(options["path"])
    wanted = {x.strip().lower() for x in options.get("extensions", "").split(",") if x.strip()}
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda path: any(x.startswith((".", "_")) for x in path.removeprefix(root).split("/"))
    return [Item(x.path, x.size, x.mtime_ns) for x in found if x.type == fs.FileType.File and not hidden(x.path) and (not wanted or posixpath.splitext(x.path)[1].lower() in wanted)]


def parted(items: list[Item], most: int) -> list[Part]:
    """Files in the order of their paths, as many to a partition as fit its bytes, one at least."""
    parts: list[Part] = []
    size = 0
    for item in sorted(items, key=lambda x: x.path):
        if not parts or size + item.size > most or len(parts[-1].items) >= 10_000:
            parts.append(Part([]))
            size = 0
        parts[-1].items.append(item)
        size += item.size
    return parts


def rows(options: dict, part: Part) -> Iterator[tuple]:
    from datetime import UTC, datetime

    system, _ = filesystem(options["path"])
    for item in part.items:
        try:
            with system.open_input_file(item.path) as source:
                data = source.read()
        except FileNotFoundError:
            continue  # removed since it was listed
        yield "filesystem", "file", item.path, item.path, posixpath.basename(item.path), posixpath.splitext(item.path)[1].lower(), len(data), datetime.fromtimestamp(item.stamp / 1e9, UTC), data


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        return parted(listed(self.options), int(self.options.get("partitionbytes", PARTITION_BYTES))) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows(self.options, partition)


class StreamReader(DataSourceStreamReader):
    """Files by the time they were last written: a batch holds those after one offset up to another.

    Files younger than ``settle`` seconds wait, so that all files of an instant are there before an offset passes it; a file
    that is written anew is read anew.
    """

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"stamp": -1}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - int(1e9 * float(self.options.get("settle", 2)))
        return {"stamp": max((x.stamp for x in listed(self.options) if x.stamp <= limit), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        items = [x for x in listed(self.options) if start["stamp"] < x.stamp <= end["stamp"]]
        return parted(items, int(self.options.get("partitionbytes", PARTITION_BYTES))) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "content_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


#: Providers by name; others can be added before they are registered.
PROVIDERS: dict[str, type[DataSource]] = {"filesystem": FolderSource}


def register(spark: SparkSession) -> list[str]:
    """Make all providers known to the session; returns their names."""
    for source in PROVIDERS.values():
        spark.dataSource.register(source)
    return sorted(PROVIDERS)


def health(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(provider, known, reachable, items) of each provider's root: a listing only, no content is read."""
    found = []
    for provider, path in roots.items():
        known = provider in PROVIDERS
        try:
            items = len(listed({"path": path})) if known else None
        except OSError:
            items = None
        found.append((provider, known, items is not None, items))
    return spark.createDataFrame(found, "provider string, known boolean, reachable boolean, items long")


def content(spark: SparkSession, provider: str, path: str, stream: bool = False, **options) -> DataFrame:
    """A provider's items as a table or stream of ``SCHEMA``."""
    if provider not in PROVIDERS:
        raise KeyError(f"no provider {provider}: {json.dumps(sorted(PROVIDERS))}")
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(PROVIDERS[provider].name())
    return reader.options(path=path, **{k: str(v) for k, v in options.items()}).load()
