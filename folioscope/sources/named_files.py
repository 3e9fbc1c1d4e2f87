"""A sink of named files: each row (file, content) becomes a file of that name, all of them or none.

Tasks write into a staging folder inside the target, each attempt under names of
its own, and tell the driver what they wrote.  The commit gives the files their
names and then removes those of an earlier write that are no longer meant; an
abort removes the staging folder, and what was there before stays as it was.
Files lie on any file system that pyarrow reads.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "named_files"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  #: staged name, name


def _opened(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path if path.startswith("/") else path)


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("path", folder)`` for rows (file, content)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], self.options["run"], overwrite)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, run: str, overwrite: bool) -> None:
        self.path, self.staging, self.overwrite = path, f"_staging-{run}", overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        files: list[tuple[str, str]] = []
        system, folder = _opened(self.path)
        system.create_dir(f"{folder}/{self.staging}", recursive=True)
        for row in iterator:
            if not row["file"] or "/" in row["file"] or row["file"].startswith(("_", ".")):
                raise ValueError(f"not a file's name: {row['file']!r}")
            staged = f"{self.staging}/{uuid.uuid4().hex}"
            with system.open_output_stream(f"{folder}/{staged}") as out:
                out.write((row["content"] or "").encode())
            files.append((staged, row["file"]))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files = [f for m in messages if m for f in m.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("two rows have one file's name")
        system, folder = _opened(self.path)
        before = [i.base_name for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file]
        for staged, name in files:
            system.move(f"{folder}/{staged}", f"{folder}/{name}")
        if self.overwrite:
            for name in set(before) - names:
                system.delete_file(f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = _opened(self.path)
        if system.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.staging}")


def write_named_files(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Writes rows (file, content) as files into a folder; with ``overwrite`` its other files go."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans the write knows no modules but Spark's
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("file", "content").write.format(NAME).option("path", path).option("run", uuid.uuid4().hex).mode("overwrite" if overwrite else "append").save()
