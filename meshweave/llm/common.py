"""Helpers shared by the training-data operators: scratch tables, word pattern, Arrow mapping."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and \x09 to \x0D.
SPACES = r"[\x20\x09-\x0D]+"

#: Most bytes of Parquet files that are broadcast (they unfold to a few times as much); larger tables are shuffled.
BROADCAST_BYTES = 4_000_000

#: Spark's setting that deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting of what a further file of a task costs; tasks have one each where that is much.
_OPEN_COST = "spark.sql.files.openCostInBytes"

_own_scratch: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not _own_scratch:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_scratch.append(tempfile.mkdtemp(prefix="meshweave-"))
    return _own_scratch[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage, outlive executors and can be dropped early.

    Once a table is written, nothing needs the shuffles it came from, so their files go at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = itertools.count()

    def save(self, df: DataFrame, apart: bool = False) -> DataFrame:
        """Write df as Parquet and return it as read back; its path is in the attribute `scratch_path`, the size of its files in scratch_bytes().

        With `apart`, each file that is read for it is a task of its own, where few bytes are much work.
        """
        path = f"{self.base}/{next(self.count)}"
        wanted = {_CLEANUP: "true"} | ({_OPEN_COST: str(1 << 30)} if apart else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path, compression="zstd")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        out.scratch_bytes = lambda: _files_bytes(self.spark, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            if df is not None:
                path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
                path.getFileSystem(conf).delete(path, True)


def _files_bytes(spark: SparkSession, path: str) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(conf).getContentSummary(path).getLength()


def join_small(large: DataFrame, small: DataFrame, on: str, how: str = "inner", path: str | None = None) -> DataFrame:
    """Join with a table that lies in scratch: broadcast if its files' size is within bounds, else as Spark sees fit."""
    size = _files_bytes(large.sparkSession, path or small.scratch_path)
    return large.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


class Names:
    """Names for working columns that clash with none of a table's own: names.x is the same for the same x."""

    def __init__(self, df: DataFrame, prefix: str = "_w"):
        self._prefix = prefix
        while any(c.lower().startswith(self._prefix) for c in df.columns):
            self._prefix += "_"

    def __getattr__(self, name: str) -> str:
        return f"{self._prefix}_{name}"

    def drop_from(self, df: DataFrame) -> DataFrame:
        """The table without working columns."""
        return df.drop(*[c for c in df.columns if c.startswith(self._prefix)])


def barrier(df: DataFrame, **columns) -> DataFrame:
    """Add columns that later expressions use without computing them again (a one-row generator stops inlining)."""
    names = list(columns)
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(packed).alias(*names))


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow in slices of at most `rows` rows, so that the Python worker holds little at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from function(batch.slice(at, rows))

    return df.mapInArrow(run, schema)
