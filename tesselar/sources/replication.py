"""A stream of message files with the log position as its offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _list(path: str) -> list[tuple[int, str]]:
    """(last lsn, path) of the files <lsn>.log, sorted."""
    from pyarrow import fs

    uri = path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}"
    where, folder = fs.FileSystem.from_uri(uri)
    if where.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    files = where.get_file_info(fs.FileSelector(folder))
    return sorted((int(f.base_name[:-4]), f.path) for f in files if re.fullmatch(r"\d+\.log", f.base_name))


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, start: int):
        self.path, self.start = path, start

    def initialOffset(self) -> dict:
        return {"lsn": self.start}

    def latestOffset(self) -> dict:
        """The newest position; the source is told nothing, a consumer acknowledges by its checkpoint."""
        return {"lsn": max([n for n, _ in _list(self.path)], default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task per file whose last position lies in (start, end]."""
        return [InputPartition(x) for x in _list(self.path) if start["lsn"] < x[0] <= end["lsn"]]

    def read(self, partition: InputPartition) -> Iterator:
        """The file in pieces of whole transactions, each a batch of its own, so that no batch grows with the file."""
        import pyarrow as pa
        from pyarrow import fs

        from .pgoutput import pieces

        lsn, path = partition.value
        uri = self.path if re.match(r"[a-z0-9+.-]+:", self.path) else f"file://{self.path}"
        where, _ = fs.FileSystem.from_uri(uri)
        with where.open_input_file(path) as f:
            for piece in pieces(f):
                yield pa.RecordBatch.from_arrays([pa.array([lsn], pa.int64()), pa.array([piece], pa.binary())], ["lsn", "content"])


class ReplicationSource(DataSource):
    """spark.readStream.format("replication").load(path): files <lsn>.log of whole transactions, named by their last position; option start: the position to begin after."""

    @classmethod
    def name(cls) -> str:
        return "replication"

    def schema(self) -> str:
        return "lsn long, content binary"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("start", "0")))
