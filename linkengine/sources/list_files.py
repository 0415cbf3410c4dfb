"""Exported lists as files, one per list, by a sink that ``df.write`` can name.

    register(spark)
    export.export_lists(lists, items, "csv").write.format("linkengine_lists").mode("append").save(path)

Rows need ``filename`` and ``content``. A task writes its files to a hidden folder of its own; when all tasks are done their
files are moved to the path, and if one fails for good nothing is (a task that is still writing then may leave its hidden folder). A task that runs twice writes two folders, of which only the one it
reports is moved. A name that two rows share, or that is no plain file name, fails the write; one that is there already
fails it in mode ``append`` and is replaced in mode ``overwrite``, which leaves other files alone. Null content is an empty file. Paths are those that
``pyarrow.fs`` opens from every executor.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "linkengine_lists"
#: Files moved at once.
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    """The hidden folder of a task, which lists its files."""

    folder: str
    files: int


class ListFilesWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if not {"filename", "content"} <= set(columns):
            raise ValueError("rows need filename and content")
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"
        where, root = self._open()
        where.create_dir(f"{root}/{self.job}", recursive=True)

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        where, root = self._open()
        folder, n = f"{root}/{self.job}/{uuid.uuid4().hex}", 0
        where.create_dir(folder, recursive=False)  # not once the write is given up
        seen: set[str] = set()
        for row in iterator:
            name = row["filename"]
            if not name or "/" in name or "\\" in name or "\x00" in name or name.startswith(".") or name.startswith("_"):
                raise ValueError(f"not a plain file name: {name!r}")
            if name in seen:
                raise ValueError(f"two lists share the file name {name}")
            seen.add(name)
            with where.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["content"] or "").encode())
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        where, root = self._open()
        files = [f for m in messages if m for f in where.get_file_info(fs.FileSelector(m.folder))]
        twice = [n for n, c in Counter(f.base_name for f in files).items() if c > 1]
        if twice:
            raise ValueError(f"two lists share the file name {twice[0]}")
        there = {f.base_name for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True))} if not self.overwrite else set()
        old = next((f.base_name for f in files if f.base_name in there), None)
        if old:
            raise FileExistsError(f"{old} is there already")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: where.move(f.path, f"{root}/{f.base_name}"), files))
        self.abort(messages)  # nothing but empty folders, and what tasks that ran twice left

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what tasks wrote and nobody moved."""
        from pyarrow import fs

        where, root = self._open()
        if where.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.job}")


class ListFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ListFilesWriter:
        return ListFilesWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the sink known to a session."""
    spark.dataSource.register(ListFiles)
