"""Points and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.grid import cell_coordinate, pack
from cellweave.params import Params


def point_table(df: DataFrame, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """id BIGINT, x FLOAT, y FLOAT; coordinates of any other type are refused."""
    for name in (x, y):
        if not isinstance(df.schema[name].dataType, T.FloatType):
            raise ValueError(f"coordinates must be float32, column {name} is {df.schema[name].dataType.simpleString()}")
    return df.select(F.col(id).cast("long").alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))


def check_points(points: DataFrame, params: Params, unique: bool = True) -> int:
    """The number of points; raises for null ids, null or non-finite coordinates, cells beyond 32 bits, repeated ids.

    ``unique=False`` leaves out the test of repeated ids, which costs a shuffle.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = finite(F.col("x")) & finite(F.col("y"))
    reach = F.greatest(*[F.max(F.abs(cell_coordinate(F.when(ok, F.col(c)), params.inv_r))) for c in ("x", "y")])
    n, bad, ids, far = points.agg(F.count(F.lit(1)), F.count_if(~ok), F.count_if(F.col("id").isNull()), reach).first()
    if bad:
        raise ValueError(f"{bad} points have null or non-finite coordinates")
    if ids:
        raise ValueError(f"{ids} points have a null id")
    if n and far >= (1 << 31) - 2:
        raise ValueError("coordinates are too large for cells of this eps")
    if unique and n and not points.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("ids must be unique")
    return n


def with_cells(points: DataFrame, params: Params) -> DataFrame:
    kx, ky = (cell_coordinate(F.col(c), params.inv_r) for c in ("x", "y"))
    return points.select("id", "x", "y", kx.alias("kx"), ky.alias("ky")).withColumn("cell", pack(F.col("kx"), F.col("ky")))


def cell_table(points: DataFrame) -> DataFrame:
    """One row per occupied cell: its coordinates, size and bounding box."""
    return points.groupBy("cell").agg(
        F.first("kx").alias("kx"),
        F.first("ky").alias("ky"),
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("xmin"),
        F.max("x").alias("xmax"),
        F.min("y").alias("ymin"),
        F.max("y").alias("ymax"),
    )
