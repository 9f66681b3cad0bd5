"""One nested document per run, with all its series, as a Spark data source.

``df.write.format("run_documents")`` takes rows ``run_id, series, ord, item`` (an item is the
JSON of one row of a series), dealt by run and sorted.  A task streams each run into a file
of its own, in a folder of the write job; the name holds the task attempt.  The files are
invisible until the driver publishes a manifest of the successful attempts by one rename, so
a retried or lost task, or a failed job, leaves no half document.  A later manifest replaces
the documents of its runs; with ``overwrite`` it replaces all.

Reading gives ``run_id, document``.  Files are reached through Arrow's file systems, so the
path may name any store that they know.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

# readers and writers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "run_documents"
FILES_PER_TASK = 64


def _store(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


def _names(system, folder: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task attempt, by run."""

    files: dict[str, str]


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str]]


class _Document:
    """A document that is written item by item, series after series."""

    def __init__(self, out, run: str, series: list[str]):
        self.out, self.run, self.rest, self.open = out, run, list(series), None
        self._write('{"run_id":' + json.dumps(run))

    def _write(self, text: str) -> None:
        self.out.write(text.encode())

    def _go_to(self, series: str | None) -> None:
        """Close the open series; those on the way to the next are empty."""
        if self.open is not None:
            self._write("]")
        while self.rest and self.rest[0] != series:
            self._write("," + json.dumps(self.rest.pop(0)) + ":[]")
        self.open = self.rest.pop(0) if self.rest else None
        if self.open is not None:
            self._write("," + json.dumps(self.open) + ":[")

    def add(self, series: str, item: str) -> None:
        if series != self.open:
            if series not in self.rest:
                raise ValueError(f"{series} is no series of the document, or rows are not sorted")
            self._go_to(series)
        else:
            self._write(",")
        self._write(item)

    def close(self) -> None:
        self._go_to(None)
        self._write("}")
        self.out.close()


class RunDocumentWriter(DataSourceWriter):
    def __init__(self, path: str, series: list[str], overwrite: bool):
        self.path, self.series, self.overwrite = path, series, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        system, root = _store(self.path)
        folder = f"{root}/documents/{self.job}"
        system.create_dir(folder, recursive=True)
        files: dict[str, str] = {}
        document = None
        for row in iterator:
            if document is None or row.run_id != document.run:
                if document is not None:
                    document.close()
                if row.run_id in files:
                    raise ValueError("rows must come sorted by run and series")
                name = f"{quote(row.run_id, safe='')}.{attempt}.json"
                files[row.run_id] = f"documents/{self.job}/{name}"
                document = _Document(system.open_output_stream(f"{folder}/{name}"), row.run_id, self.series)
            document.add(row.series, row.item)
        if document is not None:
            document.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _store(self.path)
        folder = f"{root}/commits"
        system.create_dir(folder, recursive=True)
        files = {run: file for m in messages if m is not None for run, file in m.files.items()}
        body = json.dumps({"replaces_all": self.overwrite, "files": files}).encode()
        with system.open_output_stream(f"{root}/documents/{self.job}.manifest") as out:
            out.write(body)
        # names sort by time of publication
        system.move(f"{root}/documents/{self.job}.manifest", f"{folder}/{time.time_ns():020d}-{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _store(self.path)
        system.delete_dir_contents(f"{root}/documents/{self.job}", missing_dir_ok=True)


class RunDocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        system, root = _store(self.path)
        current: dict[str, str] = {}
        for name in _names(system, f"{root}/commits"):
            manifest = json.loads(system.open_input_stream(f"{root}/commits/{name}").read())
            current = manifest["files"] if manifest["replaces_all"] else current | manifest["files"]
        files = sorted(current.items())
        return [Files(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, root = _store(self.path)
        for run, file in partition.paths:
            yield run, system.open_input_stream(f"{root}/{file}").read().decode()


class RunDocuments(DataSource):
    """Options: ``path`` and, for writing, ``series`` (a JSON list that names them in order)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "run_id string, document string"

    def writer(self, schema, overwrite: bool) -> RunDocumentWriter:
        return RunDocumentWriter(self.options["path"], json.loads(self.options["series"]), overwrite)

    def reader(self, schema) -> RunDocumentReader:
        return RunDocumentReader(self.options["path"])


def write_run_documents(
    results: Mapping[str, DataFrame],
    path: str,
    order: Mapping[str, list[str]] | None = None,
    mode: str = "append",
) -> None:
    """All series of each run as one document; a series without rows is an empty list.

    Every frame has ``run_id``; its rows are listed in the order of the columns in ``order``,
    or of all its columns.  A run without any row has no document.
    """
    spark = next(iter(results.values())).sparkSession
    spark.dataSource.register(RunDocuments)
    rows = None
    for place, (name, frame) in enumerate(results.items()):
        columns = [c for c in frame.columns if c != "run_id"]
        listed = Window.partitionBy("run_id").orderBy(*((order or {}).get(name) or columns))
        part = frame.filter("run_id IS NOT NULL").select(
            F.col("run_id").cast("string").alias("run_id"),
            F.lit(name).alias("series"),
            F.row_number().over(listed).cast("long").alias("ord"),
            F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("item"),
            F.lit(place).alias("place"),
        )
        rows = part if rows is None else rows.unionAll(part)
    dealt = rows.repartition("run_id").sortWithinPartitions("run_id", "place", "ord").drop("place")
    writer = dealt.write.format(FORMAT).mode(mode).option("path", path)
    writer.option("series", json.dumps(list(results))).save()


def read_run_documents(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The series of all published documents; ``schemas`` names the columns of each."""
    spark.dataSource.register(RunDocuments)
    documents = spark.read.format(FORMAT).option("path", path).load()
    whole = ", ".join(f"`{name}`: array<struct<{columns}>>" for name, columns in schemas.items())
    parsed = documents.select("run_id", F.from_json("document", f"struct<{whole}>").alias("d"))
    return {name: parsed.select("run_id", F.inline(f"d.{name}")) for name in schemas}
