"""A Spark data source that gives the length and SHA-256 of files, each read in pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that a task holds of a file.
PIECE = 8 << 20
SCHEMA = "path string, file string, name string, bytes bigint, sha256 string"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the place in it that a path or address names; ``ValueError`` if it is of a kind unknown here."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    try:
        return pafs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError) as why:
        raise ValueError(f"no way to open {path} in pieces: {why}") from why


def digest(store: pafs.FileSystem, place: str) -> tuple[int, str]:
    h, n = hashlib.sha256(), 0
    with store.open_input_stream(place, compression=None) as stream:
        while piece := stream.read(PIECE):
            h.update(piece)
            n += len(piece)
    return n, h.hexdigest()


class DigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern, self.tasks = options["path"], options.get("pattern"), int(options.get("tasks", "8"))

    def partitions(self) -> list[InputPartition]:
        """Files by size, largest first, each to the task that has the fewest bytes so far."""
        store, root = open_store(self.path)
        root = root.rstrip("/")
        info = store.get_file_info(root or "/")
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root or "/", recursive=True))
        files = [f for f in found if f.is_file and (not self.pattern or fnmatchcase(f.base_name, self.pattern))]
        # as Spark's own readers, without hidden files and what a writer has not committed
        kept = [(f.size or 0, f.path[len(root) + 1 :] or f.base_name) for f in files]
        kept = [(n, p) for n, p in kept if not any(part.startswith((".", "_")) for part in p.split("/"))]
        tasks: list[tuple[int, list[str]]] = [(0, []) for _ in range(max(1, min(self.tasks, len(kept))))]
        for size, place in sorted(kept, reverse=True):
            k = min(range(len(tasks)), key=lambda i: (tasks[i][0], len(tasks[i][1])))
            tasks[k] = (tasks[k][0] + size, [*tasks[k][1], place])
        return [InputPartition(t[1]) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, root = open_store(self.path)
        root = root.rstrip("/")
        alone = store.get_file_info(root).is_file if root else False
        for place in partition.value:
            at = root if alone else f"{root}/{place}"
            n, hexed = digest(store, at)
            yield at, place, place.rsplit("/", 1)[-1], n, hexed


class DigestSource(DataSource):
    """``spark.read.format("file_digests").option("pattern", ...).option("tasks", ...).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DigestReader(dict(self.options))
