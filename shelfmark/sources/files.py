"""Data sources of whole files: a listing partitioned by subtree, and a sink of one text file per row.

``register(spark)`` makes both known; paths are of any file system that pyarrow knows (a plain path is a mounted folder that
driver and executors share).

* ``spark.read.format("file_tree").load(root)``: path (relative), size, modified (seconds).  The driver lists ``depth`` levels
  (option, 1) and no more; each folder found there is a partition that an executor walks.  Folders named in the option
  ``skip`` (comma-separated, ``.media``) are left out with all below them.
* ``df.write.format("text_files").save(root)``: rows (path, value) become files.  A task writes into a folder of its own below
  ``root/_staged-...``; the commit moves the files of the tasks that Spark names to their places, an abort removes the
  folder.  So neither a failed job nor a second attempt of a task leaves a file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at.rstrip("/")


@dataclass
class Subtree(InputPartition):
    """A folder, with all below it or only its own files."""

    path: str
    recursive: bool

    def __post_init__(self) -> None:
        super().__init__(self.path)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, depth: int, skip: set[str]):
        self.root, self.depth, self.skip = root, depth, skip

    def _below(self, at: str, recursive: bool = False) -> list[fs.FileInfo]:
        return opened(self.root)[0].get_file_info(fs.FileSelector(at, recursive=recursive))

    def partitions(self) -> list[Subtree]:
        level, out = [opened(self.root)[1]], []
        for _ in range(self.depth):
            out += [Subtree(at, False) for at in level]
            level = [x.path for at in level for x in self._below(at) if x.type == fs.FileType.Directory and x.base_name not in self.skip]
        return out + [Subtree(at, True) for at in level]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        top = opened(self.root)[1]
        todo = [partition.path]
        while todo:
            for x in self._below(todo.pop()):
                if x.type == fs.FileType.File:
                    yield posixpath.relpath(x.path, top), x.size, int(x.mtime.timestamp())
                elif x.type == fs.FileType.Directory and partition.recursive and x.base_name not in self.skip:
                    todo.append(x.path)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, size long, modified long"

    def reader(self, schema) -> TreeReader:
        skip = self.options.get("skip", ".media")
        return TreeReader(self.options["path"], int(self.options.get("depth", 1)), {s for s in skip.split(",") if s})


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put which files."""

    folder: str
    paths: list[str] = field(default_factory=list)


class TextFilesWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.staged = root, overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = opened(self.root)
        done = Written(f"{root}/{self.staged}/{uuid.uuid4().hex}")  # a second attempt has a folder of its own
        for row in iterator:
            path = posixpath.normpath(row["path"])
            if path.startswith(("/", "..")):
                raise ValueError(f"{path} lies outside the folder")
            system.create_dir(posixpath.dirname(f"{done.folder}/{path}"), recursive=True)
            with system.open_output_stream(f"{done.folder}/{path}") as out:
                out.write((row["value"] or "").encode())
            done.paths.append(path)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not x.base_name.startswith("_staged-"):
                    system.delete_dir(x.path) if x.type == fs.FileType.Directory else system.delete_file(x.path)
        system.create_dir(root, recursive=True)
        for m in filter(None, messages):
            for folder in sorted({posixpath.dirname(p) for p in m.paths}):
                system.create_dir(f"{root}/{folder}", recursive=True)
            for p in m.paths:
                system.move(f"{m.folder}/{p}", f"{root}/{p}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = opened(self.root)
        if system.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staged}")


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
    spark.dataSource.register(TextFiles)
