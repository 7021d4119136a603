"""A message log as a streaming source and sink: folders of JSON lines, in any store that Arrow can open.

The source's offset is the number of segment files, by name, that have been read; a segment is immutable once it is there. The
sink's tasks write files of their own, and the driver makes a batch visible by one manifest that names them. A manifest is
written once under the batch's number: a batch that runs again after a failure finds it and leaves the log as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.replace("file:", "file://", 1)) if path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Endings of segment files.
SEGMENTS = (".json", ".txt")


def names(path: str, suffix: str | tuple[str, ...]) -> list[str]:
    """The files of a folder with such an ending, hidden ones aside, in order of their names."""
    held, root = store(path)
    found = held.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


@dataclass
class Segment(InputPartition):
    path: str
    number: int


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        return {"segments": len(names(self.path, SEGMENTS))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = names(self.path, SEGMENTS)[start["segments"] : end["segments"]]
        return [Segment(p, start["segments"] + i) for i, p in enumerate(found)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        held, _ = store(self.path)
        with held.open_input_stream(partition.path) as stream:
            at, rest = 0, b""
            while block := stream.read(1 << 22):  # a segment of any length goes by in blocks
                *whole, rest = (rest + block).split(b"\n")
                yield self.rows(partition.number, at, whole)
                at += len(whole)
            if rest:
                yield self.rows(partition.number, at, [rest])

    @staticmethod
    def rows(number: int, at: int, lines: list[bytes]) -> pa.RecordBatch:
        text = [x.decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([number] * len(text), pa.int32()), pa.array(range(at, at + len(text)), pa.int64()), pa.array(text, pa.string())], names=["segment", "line", "value"])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LogWriter(DataSourceStreamWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, rows: Iterator) -> Written:
        held, root = store(self.path)
        held.create_dir(f"{root}/data", recursive=True)
        name, n = f"data/{uuid.uuid4().hex}.json", 0
        with held.open_output_stream(f"{root}/{name}") as out:
            for row in rows:
                out.write(json.dumps(dict(zip(self.columns, row)), default=str).encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        held, root = store(self.path)
        held.create_dir(f"{root}/batches", recursive=True)
        done = f"{root}/batches/{batchId:012d}.manifest"
        if held.get_file_info(done).type != fs.FileType.NotFound:  # the batch ran before: its rows are there
            return self.abort(messages, batchId)
        new = f"{root}/batches/_{uuid.uuid4().hex}"
        with held.open_output_stream(new) as out:
            out.write(json.dumps([[m.file, m.rows] for m in messages if m is not None]).encode())
        held.move(new, done)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        held, root = store(self.path)
        for m in messages:
            if m is not None:
                held.delete_file(f"{root}/{m.file}")


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").load(path)`` gives segment, line, value; ``writeStream`` takes rows of any columns."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "segment int, line long, value string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log's visible batches."""
    held, root = store(path)
    files: list[str] = []
    for manifest in names(f"{path}/batches", ".manifest"):
        with held.open_input_stream(manifest) as stream:
            files += [f"{path}/{name}" for name, rows in json.loads(stream.read()) if rows]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
