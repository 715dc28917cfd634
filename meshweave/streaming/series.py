"""Time series as streams: follow a collection's steps, and append steps as they come."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceStreamReader

from ..sources.meshfile import MeshPart, mesh_parts, read_part, split_parts
from ..sources.vtkxml import file_stamp, series_steps


class SeriesStreamReader(DataSourceStreamReader):
    """Rows of the steps that a collection has got since the last trigger.

    The offset is the number of steps read; each piece of each new step is a task of its own, or several if it is large.
    """

    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.mesh_schema = path, table, schema
        self.known = 0

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        # a collection that is being rewritten may be missing for a moment; steps never get fewer
        if file_stamp(self.path):
            self.known = max(self.known, len(series_steps(self.path)))
        return {"step": self.known}

    def partitions(self, start: dict, end: dict) -> Sequence[MeshPart]:
        return split_parts([p for p in mesh_parts(self.path) if start["step"] <= p.step < end["step"]], self.table, self.mesh_schema.names)

    def read(self, part: MeshPart) -> Iterator[pa.RecordBatch]:
        yield from read_part(part, self.table, self.mesh_schema)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def append_steps(stream: DataFrame, make_mesh, path: str, checkpoint: str, **options):
    """Write each micro-batch as the next step of a collection: make_mesh(batch) gives (time, Mesh).

    Batches have numbers, and a batch that is run again rewrites its own step, so none is written twice.
    """
    from ..operators.mesh import SeriesWriter

    writer = SeriesWriter(path, **options)

    def write(batch: DataFrame, number: int) -> None:
        time, mesh = make_mesh(batch)
        writer.write_step(number, time, mesh)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
