"""A data source of whole files, empty ones too, and a data sink of one file a row.

``spark.read.format("whole_files")`` lists the files below a folder on the driver and reads them in
partitions of about ``partitionBytes``. Spark's own file sources pass over empty files, which
are uploads with an error here. A file over ``maxBytes`` comes without its content.

``df.write.format("whole_files")`` writes each row (name, content) to a file of its own. Tasks write
into folders of their own below a hidden one, which one rename publishes when all have ended; what failed
attempts wrote is removed first, and a failed job leaves nothing. An overwriting job removes earlier
runs after its own is there, so a reader meets a whole result at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "whole_files"
FILES = "path string, modificationTime timestamp, length long, content binary"
PARTITION_BYTES, MAX_BYTES = 64_000_000, 20_000_000
#: Besides its bytes, a file costs about so many to open.
OPEN_BYTES = 100_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def _file_name(name: str) -> str:
    """A name without separators, and none that hides a file."""
    safe = quote(name, safe="")
    return safe if safe[:1] not in ("", ".", "_") else f"%{safe[:1].encode().hex().upper()}{safe[1:]}"


@dataclass
class Files(InputPartition):
    entries: list[tuple[str, int, float]]  # path, length, modification time


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES))

    def partitions(self) -> list[Files]:
        system, root = _at(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = [f for f in found if f.type == fs.FileType.File and not self._hidden(f.path[len(root) :])]
        if self.suffixes:
            names = [f for f in names if f.path.lower().endswith(self.suffixes)]
        out, own, size = [], [], 0
        for f in sorted(names, key=lambda f: f.path):
            own.append((f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0))
            size += OPEN_BYTES + min(f.size, self.max_bytes)
            if size >= self.partition_bytes:
                out.append(Files(own))
                own, size = [], 0
        return [*out, Files(own)] if own or not out else out

    @staticmethod
    def _hidden(path: str) -> bool:
        return any(p[:1] in "._" for p in path.split("/") if p)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _at(self.path)
        for path, length, changed in partition.entries:
            content = None
            if length <= self.max_bytes:
                with system.open_input_stream(path) as f:
                    content = f.read()
            yield path, datetime.fromtimestamp(changed, timezone.utc), length, content


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of the attempt that counts; empty if it had no rows
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex

    @property
    def _hidden(self) -> str:
        return f"_writing-{self.run}"

    def begin(self) -> FilesWriter:
        """The hidden folder is made before any task runs."""
        system, root = _at(self.path)
        system.create_dir(f"{root}/{self._hidden}")
        return self

    def write(self, iterator: Iterator) -> Written:
        system, root = _at(self.path)
        task = TaskContext.get()
        folder = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        used: dict[str, int] = {}
        for name, content in iterator:
            if not used:
                # Not its parent: once the job has been given up, a task that still runs fails here.
                system.create_dir(f"{root}/{self._hidden}/{folder}", recursive=False)
            safe = _file_name(str(name))
            used[safe] = used.get(safe, 0) + 1
            numbered = safe if used[safe] == 1 else f"{safe}~{used[safe]}"  # rows of one name get files each
            with system.open_output_stream(f"{root}/{self._hidden}/{folder}/{numbered}{self.suffix}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Written(folder if used else "", sum(used.values()))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        hidden, kept = f"{root}/{self._hidden}", {m.folder for m in messages if m}
        for f in system.get_file_info(fs.FileSelector(hidden)):
            if f.base_name not in kept:  # an attempt that was given up
                system.delete_dir(f.path)
        system.move(hidden, f"{root}/run-{self.run}")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith("run-") and f.base_name != f"run-{self.run}":
                    system.delete_dir(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        hidden = f"{root}/{self._hidden}"
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite).begin()


def read_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder, empty ones too."""
    spark.dataSource.register(WholeFiles)
    return spark.read.format(FORMAT).options(**options).load(path)


def write_files(df: DataFrame, path: str, name_col: str, content_col: str, mode: str = "append", **options: object) -> None:
    """A file for each row of ``df``, named by ``name_col``, with ``content_col`` (text or bytes; null is empty)."""
    df.sparkSession.dataSource.register(WholeFiles)
    df.select(name_col, content_col).write.format(FORMAT).options(**options).mode(mode).save(path)
