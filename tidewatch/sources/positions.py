"""A prepared series as a stream whose offsets are row positions.

    spark.dataSource.register(SeriesSource)
    spark.readStream.format("series").option("path", ...).option("step", 80).option("progress", ...).load()

Every micro-batch brings the next ``step`` positions of a stored series (Parquet with a dense ``idx``), read by range in
``tasks`` tasks.  Files are opened through Arrow's file systems in the workers: the folder must be one that they
reach (a mounted path, or an address that Arrow knows).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> ds.Dataset:
    system, place = _place(path)
    return ds.dataset(place, format="parquet", filesystem=system)


class Span(InputPartition):
    """Positions ``start`` to ``stop`` (exclusive)."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class SeriesReader(DataSourceStreamReader):
    """Hands out positions step by step.

    The engine does not tell a reader how far a query has come, so what was handed out last is kept in the ``progress`` file, written before the
    engine learns of it.  A reader that starts anew hands the same out once more: the engine has either logged it, and sees nothing new,
    or has not, and takes it now.  No position is left out or taken twice.
    """

    def __init__(self, path: str, step: int, progress: str, tasks: int, schema: StructType):
        self.path, self.step, self.progress, self.tasks, self.names = path, step, progress, tasks, schema.names
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        if self.at is None and (stored := self._stored()) is not None:
            self.at = stored
            return {"at": self.at}
        self.at = min((self.at or 0) + self.step, max(self.at or 0, _files(self.path).count_rows()))
        self._store(self.at)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        first, last = start["at"], end["at"]
        if last < first:
            raise ValueError(f"{self.progress} is behind the checkpoint of the query ({last} < {first}): each query needs its own")
        size = max(1, -(-(last - first) // self.tasks))
        return [Span(at, min(at + size, last)) for at in range(first, last, size)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        inside = (pc.field("idx") >= partition.start) & (pc.field("idx") < partition.stop)
        for batch in _files(self.path).to_batches(columns=self.names, filter=inside):
            if batch.num_rows:
                yield batch

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass

    def _stored(self) -> int | None:
        system, place = _place(self.progress)
        if system.get_file_info(place).type == pafs.FileType.NotFound:
            return None
        with system.open_input_stream(place) as file:
            return json.loads(file.readall())["at"]

    def _store(self, at: int) -> None:
        system, place = _place(self.progress)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place + ".new") as file:
            file.write(json.dumps({"at": at}).encode())
        system.move(place + ".new", place)


class SeriesSource(DataSource):
    """Options: ``path`` of the series, ``step`` positions a micro-batch, ``progress`` (a file of the query's own), ``tasks`` (8)."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> StructType:
        return from_arrow_schema(_files(self.options["path"]).schema)

    def streamReader(self, schema: StructType) -> SeriesReader:
        step = int(self.options["step"])
        if step < 1:
            raise ValueError("step must be at least one position")
        return SeriesReader(self.options["path"], step, self.options["progress"], int(self.options.get("tasks", "8")), schema)
