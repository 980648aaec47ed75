"""The last bytes of files as lines: a data source that seeks, so that what is read doesn't grow with the file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "file_tail"
SCHEMA = "path string, mtime timestamp, line_no long, value string"


class Tail(InputPartition):
    def __init__(self, path: str):
        self.path = path


def last_lines(path: str, size: int) -> tuple[int | None, list[str]]:
    """(time in microseconds, whole lines that aren't blank) of a file's last ``size`` bytes; a line that begins before them is left out."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = store.get_file_info(name)
    if info.type != fs.FileType.File or not info.size:
        return None, []
    # one byte more tells whether the first line is whole
    start = max(0, info.size - size - 1)
    with store.open_input_file(name) as file:
        file.seek(start)
        data = file.read(info.size - start)
    if start:
        cut = data.find(b"\n")
        data = data[cut + 1 :] if cut >= 0 else b""
    lines = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in data.split(b"\n")]
    return info.mtime_ns // 1000 if info.mtime_ns else None, [x for x in lines if x.strip()]


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.bytes = json.loads(options["files"]), int(options["bytes"])

    def partitions(self) -> list[InputPartition]:
        return [Tail(p) for p in self.paths] or [Tail("")]

    def read(self, part: Tail) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        mtime, lines = last_lines(part.path, self.bytes)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines), pa.string()), pa.array([mtime] * len(lines), pa.timestamp("us", "UTC")), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], ["path", "mtime", "line_no", "value"])


class TailSource(DataSource):
    """Options: ``files`` (a JSON list of paths or addresses), ``bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TailReader(dict(self.options))


def read_tail(spark: SparkSession, paths: list[str], size: int = 512 * 1024) -> DataFrame:
    """(path, mtime, line_no, value) of the whole lines in the last ``size`` bytes of each file; absent files have none. Lines are numbered from 1 in each tail."""
    spark.dataSource.register(TailSource)
    return spark.read.format(FORMAT).options(files=json.dumps(paths), bytes=str(size)).load()
