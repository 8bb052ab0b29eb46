"""A streaming source over oplog files that still grow.

Each device appends JSON lines to its files, in a folder that the driver and all executors have mounted. The source's offset is the size of
each file, so it never goes back, and taking it only lists the folder. A line belongs to the stretch of bytes in which its line break
lies: a line that is still being written waits, and stretches of one file are read by different tasks without sharing a line.
Where there is no such mount, writers rotate to new files and Spark's own file stream reads them, see `replay.oplog_stream`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "device_id string, file_name string, line_no bigint, line string"
_STEP = 1 << 16


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _line_start(f, at: int) -> int:
    """Where the line begins that the byte before `at` belongs to, or `at` itself after a line break."""
    while at > 0:
        low = max(0, at - _STEP)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


class OplogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("maxBytesPerTask", 64 << 20))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({str(p): p.stat().st_size for p in Path(self.root).glob("*/*.jsonl")}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        return [Stretch(p, x, min(x + self.split, e)) for p, e in sorted(b.items()) for x in range(a.get(p, 0), e, self.split)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        p = Path(partition.path)
        with p.open("rb") as f:
            at = _line_start(f, partition.start)
            f.seek(at)
            while at < partition.end:
                raw = f.readline()
                if not raw.endswith(b"\n") or at + len(raw) > partition.end:
                    return
                if at + len(raw) > partition.start:
                    yield p.parent.name, p.name, at, raw.decode("utf-8", "replace").rstrip("\r\n")
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass


class OplogSource(DataSource):
    """spark.dataSource.register(OplogSource); spark.readStream.format("oplog").load(folder): device folders with .jsonl files.
    line_no is the byte offset of the line, which orders the lines of a file."""

    @classmethod
    def name(cls) -> str:
        return "oplog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> OplogReader:
        return OplogReader(self.options)
