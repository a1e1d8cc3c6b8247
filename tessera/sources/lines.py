"""Lines of growing files as a stream: a Spark data source, ``appended_lines``.

An offset is how many bytes of each file have been read, always at the end of a
line, so a restart goes on in the middle of a file and each line comes once: a
line that is not yet ended waits for its line feed. What a micro-batch finds of a
file is dealt to tasks in pieces of about ``piece_bytes``; a line belongs to the
piece in which it begins. Offsets hold a number for every file that holds a line,
as Spark's own file log does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20


@dataclass
class _Piece(InputPartition):
    """The lines of one file that begin from ``start`` to before ``stop``, of those from ``first`` (a line's start) to ``end`` (a line's end)."""

    path: str
    first: int
    start: int
    stop: int
    end: int


def _last_line_end(source, start: int, stop: int) -> int:
    """The end of the last whole line of the bytes from start to stop; start if there is none."""
    at = stop
    while at > start:
        lo = max(start, at - BLOCK)
        source.seek(lo)
        cut = source.read(at - lo).rfind(b"\n")
        if cut >= 0:
            return lo + cut + 1
        at = lo
    return start


def _next_line_end(source, at: int, size: int) -> int | None:
    """The end of the line that goes on at ``at``, or None if it is not ended yet."""
    source.seek(at)
    while at < size:
        data = source.read(min(BLOCK, size - at))
        cut = data.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(data)
    return None


class LinesReader(DataSourceStreamReader):
    def __init__(self, path: str, piece_bytes: int):
        self.path, self.piece_bytes = path, piece_bytes

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """From the files alone, so that it is right after a restart too."""
        fs, folder = arrow_fs.FileSystem.from_uri(self.path)
        ends = {}
        for info in fs.get_file_info(arrow_fs.FileSelector(folder.rstrip("/"), recursive=True)):
            if info.type == arrow_fs.FileType.File and info.size and not info.base_name.startswith((".", "_")):
                with fs.open_input_file(info.path) as source:
                    end = _last_line_end(source, 0, info.size)
                if end:
                    ends[info.path] = end
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [_Piece(f, before.get(f, 0), at, min(n, at + self.piece_bytes), n) for f, n in after.items() for at in range(before.get(f, 0), n, self.piece_bytes)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        p, (fs, _) = partition, arrow_fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(p.path) as source:
            if source.size() < p.end:
                raise OSError(f"{p.path} is shorter than what was found of it")
            at = p.start if p.start == p.first else _next_line_end(source, p.start - 1, p.end) or p.end
            stop = p.end if p.stop == p.end else _next_line_end(source, p.stop - 1, p.end) or p.end
            source.seek(at)
            rest = b""
            while at < stop:
                data = source.read(min(BLOCK, stop - at))
                at += len(data)
                *lines, rest = (rest + data).split(b"\n")
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(lines)), pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines])], ["file", "value"])

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Options path, piece_bytes."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> LinesReader:
        return LinesReader(self.options["path"], int(self.options.get("piece_bytes", 64 << 20)))


def appended_lines(spark: SparkSession, path: str, piece_bytes: int = 64 << 20) -> DataFrame:
    """A stream (file, value) of the lines of a folder's files, also of those that grow."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("piece_bytes", piece_bytes).load(path)
