"""Core points: cells that are full by themselves need no join; points of other cells count neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.grid import box_of, float32, point_box_distance, point_box_reach, squared_distance
from cellweave.operators.stencil import OTHERS, close_pairs, shifted
from cellweave.params import Params


def full_cells(cells: DataFrame, params: Params) -> DataFrame:
    """Cells with at least min_samples points: all of their points are core."""
    return cells.filter(F.col("n") >= params.min_samples)


def near_boxes(points: DataFrame, cells: DataFrame, offsets: list[tuple[int, int]], params: Params, keep: list[str]) -> DataFrame:
    """``points`` with each occupied cell at the offsets whose box is within eps: near, its columns, and the squared
    distances that a point of it is not below (``low``) and not beyond (``reach``)."""
    boxes = cells.select(F.col("cell").alias("near"), *[c for c in cells.columns if c not in ("cell", "kx", "ky")])
    box = box_of()
    at = (F.col("x"), F.col("y"), box["xmin"], box["xmax"], box["ymin"], box["ymax"])
    joined = shifted(points, offsets).join(boxes, "near").withColumn("low", point_box_distance(*at)).filter(F.col("low") <= float32(params.eps_sq))
    return joined.select(*points.columns, "near", *keep, "low", point_box_reach(*at).alias("reach"))


def neighbour_counts(points: DataFrame, cells: DataFrame, params: Params) -> DataFrame:
    """id, n_neighbours (itself included) for the points of cells that are not full.

    Own-cell points count without a distance test. A neighbouring cell that lies within eps as a whole counts
    by its size; only the others are joined point by point.
    """
    sparse = points.join(cells.filter(F.col("n") < params.min_samples).select("cell", F.col("n").alias("own")), "cell")
    pairs = near_boxes(sparse, cells, OTHERS, params, ["n"])
    within = F.col("reach") <= float32(params.eps_sq)
    whole = pairs.filter(within).groupBy("id").agg(F.sum("n").alias("hits"))
    others = points.select(F.col("cell").alias("near"), F.col("x").alias("bx"), F.col("y").alias("by"))
    close = squared_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) <= float32(params.eps_sq)
    single = pairs.filter(~within).select("id", "x", "y", "near").join(others, "near").filter(close).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    hits = whole.unionByName(single).groupBy("id").agg(F.sum("hits").alias("hits"))
    return sparse.select("id", "own").join(hits, "id", "left").select("id", (F.col("own") + F.coalesce("hits", F.lit(0))).alias("n_neighbours"))


def undecided_cells(cells: DataFrame, params: Params) -> DataFrame:
    """cell, own (its size) of the cells that aren't full and have enough points in all boxes within eps of theirs."""
    near = close_pairs(cells, params)
    more = near.select(F.col("a_cell").alias("cell"), F.col("b_n").alias("m")).unionByName(near.select(F.col("b_cell").alias("cell"), F.col("a_n").alias("m")))
    around = more.groupBy("cell").agg(F.sum("m").alias("around"))
    return cells.filter(F.col("n") < params.min_samples).join(around, "cell").filter(F.col("n") + F.col("around") >= params.min_samples).select("cell", F.col("n").alias("own"))


def bounded_counts(points: DataFrame, cells: DataFrame, params: Params) -> DataFrame:
    """id, x, y, own, sure, most, nears: for the points of undecided cells, how many neighbours they have in any case (own
    cell and cells that lie within eps as a whole) and at most, and the cells between (24 at most)."""
    open_ = points.join(undecided_cells(cells, params), "cell")
    pairs = near_boxes(open_, cells, OTHERS, params, ["n"])
    within = F.col("reach") <= float32(params.eps_sq)
    return pairs.groupBy("id").agg(
        F.first("x").alias("x"),
        F.first("y").alias("y"),
        (F.first("own") + F.coalesce(F.sum(F.when(within, F.col("n"))), F.lit(0))).alias("sure"),
        (F.first("own") + F.sum("n")).alias("most"),
        F.collect_list(F.when(~within, F.col("near"))).alias("nears"),
    )


def reaching_points(points: DataFrame, cells: DataFrame, params: Params) -> DataFrame:
    """id of the points of cells that aren't full that have min_samples neighbours.

    Bounds settle most of them: only points that may or may not have enough meet points, of the cells between.
    """
    bounds = bounded_counts(points, cells, params).filter(F.col("most") >= params.min_samples)
    settled = F.col("sure") >= params.min_samples
    # what is settled passes with one empty cell, so that the bounds are worked out once
    open_ = bounds.select("id", "x", "y", "sure", F.explode(F.when(settled, F.array(F.lit(None).cast("long"))).otherwise(F.col("nears"))).alias("near"))
    others = points.select(F.col("cell").alias("near"), F.col("x").alias("bx"), F.col("y").alias("by"))
    close = squared_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) <= float32(params.eps_sq)
    met = open_.join(others, "near", "left").groupBy("id").agg((F.first("sure") + F.count_if(close)).alias("k"))
    return met.filter(F.col("k") >= params.min_samples).select("id")


def mark_core(points: DataFrame, cells: DataFrame, params: Params) -> DataFrame:
    """``points`` with is_core."""
    reached = reaching_points(points, cells, params).select("id", F.lit(True).alias("reached"))
    full = full_cells(cells, params).select("cell", F.lit(True).alias("full"))
    marked = points.join(full, "cell", "left").join(reached, "id", "left")
    return marked.select("id", "x", "y", "kx", "ky", "cell", (F.coalesce("full", F.lit(False)) | F.coalesce("reached", F.lit(False))).alias("is_core"))


def status(any_core: Column, all_core: Column) -> Column:
    """0: no core point, 1: some, 2: all."""
    return F.when(~any_core, 0).when(all_core, 2).otherwise(1).cast("int")


def cell_status(marked: DataFrame) -> DataFrame:
    return marked.groupBy("cell").agg(F.first("kx").alias("kx"), F.first("ky").alias("ky"), status(F.bool_or("is_core"), F.bool_and("is_core")).alias("status"))


def extremes_of(x: str, y: str) -> Column:
    """An aggregate: the points of least and largest x, and of least and largest y."""
    point = F.struct(x, y)
    return F.array(F.min_by(point, x), F.max_by(point, x), F.min_by(point, y), F.max_by(point, y))


def core_cells(marked: DataFrame) -> DataFrame:
    """Cells with core points: the box of those, their number, and four extreme ones."""
    return (
        marked.filter("is_core")
        .groupBy("cell")
        .agg(
            F.first("kx").alias("kx"),
            F.first("ky").alias("ky"),
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("xmin"),
            F.max("x").alias("xmax"),
            F.min("y").alias("ymin"),
            F.max("y").alias("ymax"),
            extremes_of("x", "y").alias("extremes"),
        )
    )
