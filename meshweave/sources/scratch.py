"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; a temporary one where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not _own:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _own.append(tempfile.mkdtemp(prefix="meshweave-"))
        shared = _own[0]
    return f"{shared.removeprefix('file://').rstrip('/')}/mesh-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The table written to a scratch folder and read back: what is drawn or sampled in it is fixed from then on."""
    path = f"file://{scratch_dir(df.sparkSession)}" if _is_local(df.sparkSession) else scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}" if path.startswith("/") else path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _is_local(spark: SparkSession) -> bool:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return not shared or shared.startswith(("/", "file:"))
