"""Meshes made of the shared test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import type_by_corners
from ..operators.grids import structured_cells, structured_points
from ..operators.mesh import Frame, Mesh

#: Points in the first direction of the grid that parts fill.
NX = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(0.0).alias("z"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each order with lines: its parts by line."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("_lines"))
    cells = lines.select("cell_id", F.transform("_lines", lambda x: x["l_partkey"]).alias("corners"))
    return cells.withColumn("cell_type", type_by_corners(F.size("corners")))


def order_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell fields of orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("totalprice"))


def order_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """Parts as points, orders as cells, with fields of both."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_partkey").alias("partkey"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("pair"))
    return Mesh("unstructured", part_points(spark, sf_dir), order_cells(spark, sf_dir), p, order_data(spark, sf_dir), {"title": "orders", "numbers": [1.0, 2.0]})


def pieced_order_mesh(spark: SparkSession, sf_dir: str, pieces: int = 4) -> Mesh:
    """The same in pieces by customer; each piece has the points that its cells need."""
    mesh = order_mesh(spark, sf_dir)
    where = mesh.cell_data.select("cell_id", (F.col("custkey") % pieces).cast("int").alias("piece"))
    cells = mesh.cells.join(where, "cell_id")
    used = cells.select("piece", F.explode("corners").alias("point_id")).distinct()
    return replace(mesh, points=mesh.points.join(used, "point_id"), cells=cells, point_data=mesh.point_data.join(used, "point_id"), cell_data=mesh.cell_data.join(where, "cell_id"))


def part_grid(spark: SparkSession, sf_dir: str, kind: str = "image") -> Mesh:
    """Parts on a grid of NX points in x: prices as point field, cell numbers halved as cell field."""
    p = table(spark, sf_dir, "part")
    n, first = p.agg(F.count("*"), F.min("p_partkey")).first()
    ny = n // NX
    cells = [NX - 1, ny - 1, 0]
    data = p.select((F.col("p_partkey") - first).alias("point_id"), F.col("p_retailprice").alias("price")).where(F.col("point_id") < NX * ny)
    frame = Frame([0, NX - 1, 0, ny - 1, 0, 0], origin=(1.0, 2.0, 0.0), spacing=(0.5, 0.25, 1.0))
    points = structured_points(spark, cells, frame.origin, frame.spacing).select("point_id", "i", "j", "k", "x", "y", "z")
    if kind == "rectilinear":
        frame = Frame(frame.whole_extent, ordinates=[[float(i * i) for i in range(NX)], [j * 0.5 for j in range(ny)], [0.0]])
        points = points.withColumn("x", (F.col("i") * F.col("i")).cast("double")).withColumn("y", F.col("j") * 0.5).withColumn("z", F.lit(0.0))
    if kind == "structured":
        points = points.withColumn("x", F.col("i") + F.col("j") * 0.25).withColumn("y", F.col("j") * 0.5).withColumn("z", F.col("i") * 0.125)
    entities = structured_cells(spark, cells, kind != "structured")
    cell_data = entities.select("cell_id", (F.col("cell_id") * 0.5).alias("half"))
    return Mesh(kind, points, entities, data, cell_data, frame=frame)


def in_two_pieces(mesh: Mesh) -> Mesh:
    """A grid cut across y; both pieces have the points of the cut, the second with prices raised by a quarter."""
    ny = mesh.frame.whole_extent[3] + 1
    cut = ny // 2
    whole = mesh.frame.whole_extent
    extents = {(0, 0): [*whole[:3], cut, *whole[4:]], (0, 1): [*whole[:2], cut, *whole[3:]]}
    points = mesh.points.join(mesh.point_data, "point_id")
    low, high = points.where(F.col("j") <= cut).withColumn("piece", F.lit(0)), points.where(F.col("j") >= cut).withColumn("piece", F.lit(1)).withColumn("price", F.col("price") + 0.25)
    both = low.unionByName(high)
    cells = mesh.cells.withColumn("piece", (F.col("j") >= cut).cast("int"))
    return replace(mesh, points=both.select("piece", "point_id", "x", "y", "z"), point_data=both.select("piece", "point_id", "price"), cells=cells.select("piece", "cell_id", "cell_type", "corners"), cell_data=mesh.cell_data.join(cells.select("cell_id", "piece"), "cell_id"), frame=replace(mesh.frame, extents=extents))


def event_series(spark: SparkSession, sf_dir: str) -> Mesh:
    """A step for each day: a line of 24 hours, with the number of events in each."""
    e = table(spark, sf_dir, "events").select(F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("day"), F.hour("ts").cast("bigint").alias("point_id"))
    first = e.agg(F.min("day")).first()[0]
    days = sorted(r["day"] - first for r in e.select("day").distinct().collect())  # a row a day
    counted = e.groupBy("day", "point_id").agg(F.count("*").alias("n")).withColumn("step", F.col("day") - first)
    grid = spark.createDataFrame([(d,) for d in days], "step int").crossJoin(spark.range(24).withColumnRenamed("id", "point_id"))
    data = grid.join(counted.drop("day"), ["step", "point_id"], "left").select("step", "point_id", F.coalesce("n", F.lit(0)).alias("n"))
    frame = Frame([0, 23, 0, 0, 0, 0], {(d, 0): [0, 23, 0, 0, 0, 0] for d in days})
    return Mesh("image", None, None, data, None, frame=frame, times={d: d * 0.25 for d in days})
