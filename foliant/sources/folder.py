"""A data source of files below a folder, listed and read in tasks: ``spark.read.format("foliant_files").load(root)``.

Spark's own file sources leave out names that begin with "_" or "."; here such files are files like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, modificationTime timestamp, content binary"
# A task hands contents on when it holds so many bytes of them.
BATCH_BYTES = 16 * 1024 * 1024
BATCH_FILES = 4096


@dataclass
class FolderSlice(InputPartition):
    """The files below a folder (or directly in it) whose names hash to one of ``of`` slices."""

    folder: str
    recursive: bool
    slice: int = 0
    of: int = 1


class FolderReader(DataSourceReader):
    """Options: ``path``; ``parts``, how many tasks to use at least; ``maxBytes`` and ``extensions`` (comma-separated), beyond which a file
    is listed with null content; ``content`` false lists only."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.parts = int(options.get("parts", "1"))
        self.max_bytes = int(options["maxbytes"]) if "maxbytes" in options else None
        self.extensions = tuple(f".{e}" for e in options["extensions"].split(",")) if options.get("extensions") else None
        self.content = options.get("content", "true") == "true"

    def partitions(self) -> list[FolderSlice]:
        """One listing, of the root alone: its folders and its own files, each cut into slices so that all tasks have work."""
        system, root = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            raise ValueError(f"no such folder: {self.root}")
        if system.get_file_info(root).type == fs.FileType.File:
            return [FolderSlice(root, False)]
        folders = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        slices = -(-self.parts // (len(folders) + 1))
        return [FolderSlice(folder, folder != root, i, slices) for folder in [root, *folders] for i in range(slices)]

    def read(self, partition: FolderSlice) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        prefix = self.root[: len(self.root) - len(fs.FileSystem.from_uri(self.root)[1])]
        info = system.get_file_info(partition.folder)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(
            fs.FileSelector(partition.folder, recursive=partition.recursive))
        mine = [i for i in found if i.type == fs.FileType.File and zlib.crc32(i.path.encode()) % partition.of == partition.slice]
        rows, held = [], 0
        for info in mine:
            content = self._content(system, info)
            rows.append((prefix + info.path, info.size, info.mtime, content))
            held += len(content or b"")
            if held > BATCH_BYTES or len(rows) >= BATCH_FILES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _content(self, system: fs.FileSystem, info: fs.FileInfo) -> bytes | None:
        known = self.extensions is None or info.base_name.lower().endswith(self.extensions)
        if not self.content or not known or (self.max_bytes is not None and info.size > self.max_bytes):
            return None
        with system.open_input_stream(info.path) as stream:
            return stream.read()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, sizes, times, contents = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(contents, pa.binary())],
        names=["path", "length", "modificationTime", "content"])


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliant_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))
