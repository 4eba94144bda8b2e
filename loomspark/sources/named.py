"""One file of a name of its own for each row: a data source that writes.

A task writes its rows' files to a folder of its own and names that folder when it is done. Only if
all tasks are, the driver moves the files of those folders to their names, so that a file of each
name is there once however often tasks were tried, and none if the job failed. Names that more than
one row has are an error before anything is moved.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_files"
STAGING = "_staging"
#: Files that the driver moves at the same time.
MOVERS = 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else posixpath.abspath(path))


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task has filled."""

    folder: str


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.run = uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str]:
        store, path = located(self.path)
        return store, posixpath.join(path, STAGING, self.run)

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, staging = self._staging()
        folder = posixpath.join(staging, uuid.uuid4().hex)  # of this try alone
        store.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name in (".", "..") or name == STAGING:
                raise ValueError(f"no file can be named {name!r}")
            if name in seen:
                raise ValueError(f"several rows are named {name!r}")
            seen.add(name)
            with store.open_output_stream(posixpath.join(folder, name)) as f:
                f.write((row["value"] or "").encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        store, staging = self._staging()
        target = posixpath.dirname(posixpath.dirname(staging))
        found = [f.path for m in messages if m is not None for f in store.get_file_info(fs.FileSelector(m.folder))]
        to = [posixpath.join(target, posixpath.basename(f)) for f in found]
        if len(set(to)) < len(to):
            self.abort(messages)
            raise ValueError("several rows have one name")
        if not self.overwrite and any(i.type != fs.FileType.NotFound for i in store.get_file_info(to)):
            self.abort(messages)
            raise ValueError(f"{self.path} holds files of these names")
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(store.move, found, to))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Remove what tasks have written, those of failed tries too."""
        store, staging = self._staging()
        for folder in (staging, posixpath.dirname(staging)):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder == staging or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class NamedFiles(DataSource):
    """Rows of name and value (text) as files under a path that driver and executors share. Mode overwrite replaces files of the same names and leaves others."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(files: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write rows of name and value as one file each."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "value").write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)
