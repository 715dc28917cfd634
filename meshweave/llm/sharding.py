"""Sharding by a two-pass external shuffle.

Pass one gives each record a seeded hash and writes it out, so that the draw is fixed whatever happens to executors.
Pass two brings records together in buckets that fit in memory, chosen by that hash, and Fisher-Yates shuffles each.
Buckets in order make one long permutation; its n-th record goes to shard n mod shards, at slot n div shards. So the
counts of any two shards differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Buckets under a common running number, so that the buckets' own starts are no single task's work.
_RUN = 4096


def shard(docs: DataFrame, shards: int = 16, seed: int = 1, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Put every record into one of `shards` shards: rows (doc, shard, slot), doc being the input row as a struct.

    The order is uniformly random under the seed and fixed by it, the records, how their files are split and the number
    of shuffle partitions (buckets follow it). Null
    texts weigh nothing; repeated rows are records of their own, and as each draws its own number, any number of them
    spreads over all buckets; an empty table gives an empty table; columns of any name stay apart in doc.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    # the number of a row in its task makes repeated rows differ; it is drawn once, as the table is written
    draw = F.xxhash64(F.lit(seed), F.spark_partition_id(), F.monotonically_increasing_id())
    drawn = scratch.save(docs.select(F.struct("*").alias("doc"), size.cast("bigint").alias("bytes"), draw.alias("draw")))
    total = drawn.agg(F.sum("bytes")).first()[0] or 0
    # several buckets a task even where all of the data would fit in a few, so that all tasks have work
    n = max(-(-total // bucket_bytes), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.col("draw"), F.lit(n)).alias("bucket")

    def shuffle(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column("draw").to_numpy(), kind="stable")
        # numpy's permutation is a Fisher-Yates shuffle
        order = order[np.random.default_rng([seed, key[0].as_py()]).permutation(len(order))]
        return pa.table([table.column("doc").take(pa.array(order)), table.column("bucket"), pa.array(np.arange(len(order), dtype=np.int64))], names=["doc", "bucket", "place"])

    schema = f"doc {drawn.schema['doc'].dataType.simpleString()}, bucket bigint, place bigint"
    mixed = drawn.select("doc", "draw", bucket).groupBy("bucket").applyInArrow(shuffle, schema)
    starts = _starts(drawn.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")), scratch)
    place = F.col("start") + F.col("place")
    return mixed.join(F.broadcast(starts) if n <= 500_000 else starts, "bucket").select("doc", (place % shards).cast("int").alias("shard"), ((place - place % shards) / shards).cast("bigint").alias("slot"))


def _starts(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, n) to (bucket, start): the number of rows in all buckets before, by runs of buckets."""
    counts = scratch.save(counts.withColumn("run", F.floor(F.col("bucket") / _RUN)))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("rows")).select("run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.select("bucket", "run", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("after")).join(runs, "run")
    return scratch.save(out.select("bucket", (F.col("first") + F.col("after")).alias("start")))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write sharded records as Parquet, a folder a shard, files and rows in order of slot."""
    part = F.floor(F.col("slot") / rows_per_file)
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
