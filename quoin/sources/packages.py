"""A sink that writes one file for each row, seen only when all rows are written.

    spark.dataSource.register(FileSink)
    df.select("name", "content").write.format("files").option("path", folder).mode("append").save()
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path on it; a path without a scheme is local."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem(), ("/" + rest.lstrip("/") if rest else path).rstrip("/")
    found, name = fs.FileSystem.from_uri(path)
    return found, name.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """(where a task has put a file, its name) of all files of the task."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Tasks write into a folder of their own job, under names of their own attempt; the commit
    moves what the successful attempts tell of, so a lost or failed task leaves nothing in sight."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = located(self.path)
        own, done = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for n, row in enumerate(iterator):
            name = row["name"]
            if not name or "/" in name or name in (".", "..") or name.startswith("_"):
                raise ValueError(f"no name of a file: {name!r}")
            if n == 0:
                files.create_dir(own)
            with files.open_output_stream(f"{own}/{n}") as out:
                out.write(bytes(row["content"] or b""))
            done.append((f"{own}/{n}", name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = located(self.path)
        moves = [m for told in messages if told is not None for m in told.files]
        names = [name for _, name in moves]
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        there = [] if self.overwrite else [i.base_name for i in files.get_file_info([f"{root}/{n}" for n in names]) if i.type != fs.FileType.NotFound]
        if twice or there:
            self.clear()
            raise ValueError(f"names that are there already or come twice: {sorted([*twice, *there])[:5]}")
        for at, name in moves:
            files.move(at, f"{root}/{name}")
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        files, root = located(self.path)
        if files.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")


class FileSink(DataSource):
    """Rows (name string, content binary) as files of the folder `path`. Null contents are empty files."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(df, path: str, mode: str = "append") -> None:
    """Write df (name, content) as files under a folder, all or none."""
    df.sparkSession.dataSource.register(FileSink)
    df.select("name", "content").write.format("files").option("path", path).mode(mode).save()
