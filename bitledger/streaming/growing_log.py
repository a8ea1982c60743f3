"""A streaming source over log files that grow: each batch reads the lines added since the last.

The stream's offset holds for every file how many bytes have been read, always up to the end of a
line; nothing else is remembered, so a restarted query goes on from its checkpoint alone. A batch's new bytes are cut into ranges, so one
long log is read by many tasks; lines never become one value. The files may lie in any store that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from bitledger.sources.stores import open_path

# Bytes that one task reads, and that one read takes.
RANGE_BYTES = 64 << 20
_READ = 1 << 20
_SCHEMA = "path string, offset bigint, line string"


def _pattern(glob: str) -> re.Pattern:
    """``*`` and ``?`` match within one folder; all else stands for itself."""
    parts = {"*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(parts.get(c) or re.escape(c) for c in glob))


def list_files(path: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the files of a path, folder or glob."""
    store, inner = open_path(path)
    fixed = inner
    if "*" in inner or "?" in inner:
        fixed = re.split(r"[*?]", inner)[0].rsplit("/", 1)[0] or "/"
    info = store.get_file_info(fixed)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(fixed, recursive=fixed != inner))
    else:
        found = []
    wanted = _pattern(inner) if fixed != inner else None
    files = [f for f in found if f.type == fs.FileType.File and (wanted is None or wanted.fullmatch(f.path))]
    return sorted((f.path, f.size) for f in files)


def last_line_end(file, start: int, size: int) -> int:
    """The place behind the last line break in ``[start, size)``; ``start`` where there is none."""
    stop = size
    while stop > start:
        begin = max(start, stop - _READ)
        file.seek(begin)
        found = file.read(stop - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        stop = begin
    return start


@dataclass
class LogRange(InputPartition):
    path: str
    first: int
    start: int
    stop: int


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, path: str, closed: bool):
        self.path, self.closed = path, closed
        # Sizes and line ends that the last call found, so that unchanged files are not opened again.
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, _ = open_path(self.path)
        for path, size in list_files(self.path):
            seen, read = self.known.get(path, (0, 0))
            if size < seen:
                raise ValueError(f"{path} shrank from {seen} to {size} bytes; a log only grows")
            if self.closed:
                read = size
            elif size > seen:
                with store.open_input_file(path) as file:
                    read = last_line_end(file, read, size)
            self.known[path] = (size, read)
        return {"files": json.dumps({path: read for path, (_, read) in self.known.items()})}

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, stop in sorted(after.items()):
            first = before.get(path, 0)
            if stop < first:
                raise ValueError(f"{path} shrank below the {first} bytes that were read; a log only grows")
            out += [LogRange(path, first, at, min(at + RANGE_BYTES, stop)) for at in range(first, stop, RANGE_BYTES)]
        return out

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range; the last of them may end beyond it."""
        store, _ = open_path(self.path)
        with store.open_input_file(partition.path) as file:
            at = partition.start
            if at > partition.first:
                # The line that the range before began ends here.
                at = _next_line(file, at - 1)
            while at < partition.stop:
                file.seek(at)
                block = file.read(_READ)
                cut = block.rfind(b"\n") + 1
                while not cut and (more := file.read(_READ)):
                    block += more
                    cut = block.rfind(b"\n") + 1
                # Only the end of a closed file has no line break.
                lines = block[:cut].split(b"\n")[:-1] if cut else [block]
                offsets = np.cumsum([0] + [len(x) + 1 for x in lines])
                inside = int(np.searchsorted(offsets[:-1] + at, partition.stop))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.path] * inside, pa.string()),
                        pa.array(offsets[:inside] + at, pa.int64()),
                        pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines[:inside]], pa.string()),
                    ],
                    ["path", "offset", "line"],
                )
                at += int(offsets[-1])


def _next_line(file, at: int) -> int:
    """The place behind the first line break from ``at`` on."""
    file.seek(at)
    while block := file.read(_READ):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return at


class GrowingLog(DataSource):
    """``format("growing_log").option("path", ...)``: path, offset and line.

    Option ``closed`` (default false): files are complete, so a last line without a break is
    read too. A line without a break otherwise waits for it. A file that shrinks is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(self.options["path"], self.options.get("closed", "false").lower() == "true")


def stream_log(
    spark: SparkSession, path: str, label_pattern: str = r"([^/]+)/[^/]+$", closed: bool = False
) -> DataFrame:
    """Lines of growing logs as ``(label, seq, line)``, for :func:`telemetry_stream_summary`.

    ``seq`` sorts the lines of a log by byte. Several logs of one label are taken one after
    another, in the order of a hash of their paths, which stays the same as they grow.
    """
    spark.dataSource.register(GrowingLog)
    rows = spark.readStream.format("growing_log").option("path", path).option("closed", str(closed).lower()).load()
    file = F.crc32("path").cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    seq = (file + F.col("offset").cast("decimal(19,0)")).cast("decimal(38,0)")
    return rows.select(F.regexp_extract("path", label_pattern, 1).alias("label"), seq.alias("seq"), "line")
