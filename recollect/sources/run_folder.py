"""A writer for folders of many small named files, such as the units of a run.

Spark names its own files; a run folder names each file itself. Tasks write into a staging
folder beside the target, each file under a name of its own attempt first, and the commit
moves the whole folder into place at once. If a task or the job fails nothing appears under
the target, and the staging folder is removed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "run_folder"


@dataclass
class Written(WriterCommitMessage):
    files: int


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked_name(name: str) -> str:
    """A relative path that stays inside its folder."""
    parts = name.split("/")
    if not name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a file name inside a run folder: {name!r}")
    return name


class RunFolderWriter(DataSourceWriter):
    def __init__(self, path: str, staging: str) -> None:
        self.path, self.staging = path, staging

    def write(self, iterator: Iterator) -> Written:
        system, root = file_system(self.staging)
        written = 0
        for row in iterator:
            target = f"{root}/{checked_name(row['path'])}"
            # Step by step, so that a task that outlives an abort cannot bring the folder back.
            for part in range(root.count("/") + 2, target.count("/") + 1):
                system.create_dir("/".join(target.split("/")[:part]), recursive=False)
            mine = f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(mine) as out:
                out.write((row["content"] or "").encode())
            system.move(mine, target)
            written += 1
        return Written(written)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, staging = file_system(self.staging)
        target = file_system(self.path)[1]
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"the run folder exists: {self.path}")
        system.move(staging, target)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, staging = file_system(self.staging)
        for _ in range(50):
            if system.get_file_info(staging).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(staging)
            except OSError:  # a task that is still being stopped wrote meanwhile
                time.sleep(0.2)


class RunFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> RunFolderWriter:
        path = self.options["path"].rstrip("/")
        folder, name = path.rsplit("/", 1)
        staging = f"{folder}/.{name}-{uuid.uuid4().hex[:12]}"
        system, root = file_system(staging)
        system.create_dir(root, recursive=True)
        return RunFolderWriter(path, staging)


def write_run_folder(files: DataFrame, path: str) -> None:
    """Write ``files`` (path, content), each under its own relative path, to the new folder ``path``.

    Paths are unique; a null content is an empty file. The folder must be one that the
    driver and all executors can reach as files.
    """
    files.sparkSession.dataSource.register(RunFolder)
    files.select("path", "content").write.format(NAME).mode("append").option("path", path).save()
