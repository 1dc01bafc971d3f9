"""Files written by many tasks at once: a sink for rows of name, offset and content.

Each task writes its rows at their offsets into files of a hidden folder beside the target.
When all tasks are done the files move to their names in the target folder, one rename
each; when the job fails the hidden folder goes. A task that runs again writes the same
bytes to the same places. The folder must be mounted on the driver and on all executors, as
writing at an offset needs a file system that has files with a middle.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "quire_placed"
SCHEMA = "name string, offset long, content binary"
#: Files that a task keeps open.
OPEN = 64


def mounted(folder: str) -> str:
    """The local path of a folder; other file systems than mounted ones are an error."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"files are written at offsets, which {parts.scheme}: has not: name a mounted folder")
    return unquote(parts.path) if parts.scheme else folder


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.hidden = os.path.join(folder, f".quire-{uuid.uuid4().hex}")
        os.makedirs(self.hidden)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files: dict[str, int] = {}
        try:
            for batch in iterator:
                for name, offset, content in zip(*[batch.column(c) for c in ("name", "offset", "content")], strict=True):
                    own = name.as_py()
                    if own in ("", ".", "..") or "/" in own:
                        raise ValueError(f"no name of a file: {own!r}")
                    if own not in files:
                        if len(files) >= OPEN:
                            os.close(files.pop(next(iter(files))))
                        files[own] = os.open(os.path.join(self.hidden, own), os.O_WRONLY | os.O_CREAT, 0o644)
                    data, at = memoryview(content.as_buffer()), offset.as_py()
                    while len(data):
                        n = os.pwrite(files[own], data, at)
                        data, at = data[n:], at + n
        finally:
            for f in files.values():
                os.fsync(f)
                os.close(f)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        for f in os.scandir(self.hidden):
            os.replace(f.path, os.path.join(self.folder, f.name))
        os.rmdir(self.hidden)

    def abort(self, messages) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class PlacedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlacedWriter(mounted(self.options["path"]))


def write_placed(rows: DataFrame, folder: str) -> None:
    """Writes rows (name, offset, content) as files of folder, which replace files of the same names."""
    rows.sparkSession.dataSource.register(PlacedFiles)
    typed = rows.selectExpr("string(name) name", "bigint(offset) offset", "binary(content) content")
    typed.write.format(FORMAT).mode("append").save(mounted(folder))
