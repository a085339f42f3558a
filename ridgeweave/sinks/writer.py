"""Spark writers for files that aren't tables: a set of named files, and one text joined from many rows.

Tasks write below a pending folder of the job; only the job's commit moves
what they wrote to its place, and a failed job leaves what was there before.
``path`` is a folder or file that the driver and all executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    partition: int
    folder: str
    names: list[str]


class Pending(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.options = dict(options)
        parent = self.path if self.kind == "folder" else os.path.dirname(self.path)
        self.pending = os.path.join(parent, f"_pending-{uuid.uuid4().hex}")

    kind = "folder"

    def place(self) -> tuple[int, str]:
        """This task's number, and a folder for this attempt of it."""
        task = TaskContext.get()
        folder = os.path.join(self.pending, f"{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(folder, exist_ok=True)
        return task.partitionId(), folder

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class FileSetWriter(Pending):
    """Rows (name, data) become files; what matches a pattern in ``stale`` (a list with bars) goes first."""

    def write(self, iterator: Iterator) -> Written:
        partition, folder = self.place()
        names = []
        for row in iterator:
            target = Path(folder, row["name"])
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(row["data"])
            names.append(row["name"])
        return Written(partition, folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        root = Path(self.path)
        root.mkdir(parents=True, exist_ok=True)
        for pattern in filter(None, self.options.get("stale", "").split("|")):
            for old in root.glob(pattern):
                if old.is_file():
                    old.unlink()
        for m in filter(None, messages):
            for name in m.names:
                (root / name).parent.mkdir(parents=True, exist_ok=True)
                os.replace(os.path.join(m.folder, name), root / name)
        shutil.rmtree(self.pending, ignore_errors=True)


class JoinedTextWriter(Pending):
    """Rows (value) in the order of partitions, as one file of ``head``, values with ``between``, and ``tail``."""

    kind = "file"

    def write(self, iterator: Iterator) -> Written:
        partition, folder = self.place()
        n = 0
        with open(os.path.join(folder, "part"), "w", encoding="utf-8", newline="") as f:
            for n, row in enumerate(iterator, 1):
                f.write((self.options.get("between", "") if n > 1 else "") + row["value"])
        return Written(partition, folder, ["part"] if n else [])

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.pending, exist_ok=True)
        whole = os.path.join(self.pending, "whole")
        with open(whole, "w", encoding="utf-8", newline="") as out:
            out.write(self.options.get("head", ""))
            held = [m for m in messages if m is not None and m.names]
            for k, m in enumerate(sorted(held, key=lambda m: m.partition)):
                if k:
                    out.write(self.options.get("between", ""))
                with open(os.path.join(m.folder, "part"), encoding="utf-8", newline="") as part:
                    shutil.copyfileobj(part, out)
            out.write(self.options.get("tail", ""))
        os.replace(whole, self.path)
        shutil.rmtree(self.pending, ignore_errors=True)


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileSetWriter(self.options)


class JoinedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "joined_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return JoinedTextWriter(self.options)


def write_files(files: DataFrame, folder: str | Path, stale: tuple[str, ...] = ()) -> None:
    """(name, data) as files below ``folder``."""
    files.sparkSession.dataSource.register(FileSet)
    Path(folder).mkdir(parents=True, exist_ok=True)
    files.write.format("file_set").option("path", str(folder)).option("stale", "|".join(stale)).mode("overwrite").save()


def write_joined(rows: DataFrame, path: str | Path, head: str = "", between: str = "\n", tail: str = "\n") -> None:
    """(value) as one file; sorted rows keep their order."""
    rows.sparkSession.dataSource.register(JoinedText)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows.write.format("joined_text").options(path=str(path), head=head, between=between, tail=tail).mode("overwrite").save()
