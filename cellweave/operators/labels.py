"""Edges between cells, cluster numbers, and labels of core and border points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.grid import box_box_distance, float32, point_box_distance, squared_distance
from cellweave.operators.components import connected_components
from cellweave.operators.core import extremes_of, near_boxes
from cellweave.operators.numbering import dense_numbers
from cellweave.operators.stencil import FULL, close_pairs
from cellweave.params import Params
from cellweave.plans.lineage import cut

NUMBERINGS = ("cell", "first_core")
#: Pairs of cells with more pairs of core points than this are first compared by parts: so many by so many.
DENSE_PAIRS, PARTS = 1_000_000, 8
#: Point pairs of a pair of cells up to which it is looked at in a step of its own, before those with more.
STEPS = (10_000, DENSE_PAIRS)
#: Up to so many point pairs in all, steps aren't worth their jobs.
ONE_STEP = 50_000_000
BOX = ("xmin", "xmax", "ymin", "ymax")


def _box(end: str) -> dict[str, Column]:
    return {k: F.col(f"{end}_{k}") for k in BOX}


def _touching(pairs: DataFrame, eps_sq: Column) -> DataFrame:
    """``pairs`` with ``touch``: whether extreme points of both ends are within eps."""
    touch = F.exists("a_extremes", lambda p: F.exists("b_extremes", lambda q: squared_distance(p["x"], p["y"], q["x"], q["y"]) <= eps_sq))
    return pairs.withColumn("touch", touch)


def _meeting(pairs: DataFrame, points: DataFrame, keys: list[str], eps_sq: Column) -> DataFrame:
    """u, v of the pairs with points (columns ``keys``, x, y) within eps; of each end only those that are within eps of the other's box meet."""
    end = lambda e: points.select(*[F.col(k).alias(f"{e}_{k}") for k in keys], F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y"))
    near = lambda e, other: point_box_distance(F.col(f"{e}x"), F.col(f"{e}y"), *_box(other).values()) <= eps_sq
    one = pairs.join(end("a"), [f"a_{k}" for k in keys]).filter(near("a", "b"))
    both = one.join(end("b"), [f"b_{k}" for k in keys]).filter(near("b", "a") & (squared_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= eps_sq))
    return both.select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v")).distinct()


def _parts(placed: DataFrame) -> DataFrame:
    """The box, size and extreme points of each part of a cell."""
    return placed.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), extremes_of("x", "y").alias("extremes"))


def _by_parts(pairs: DataFrame, cores: DataFrame, points: DataFrame, eps_sq: Column, dense_pairs: int = DENSE_PAIRS) -> DataFrame:
    """u, v of the pairs with points within eps, for dense cells.

    The boxes of the cells are cut into parts. Two parts with extreme points within eps settle a pair of cells, parts
    whose boxes are farther apart are dropped. Of the pairs of parts left, those with few point pairs meet point by point;
    the parts of the others are cut again, until none is left: a part whose points are equal is its box.
    """
    cells = pairs.select(F.explode(F.array("a_cell", "b_cell")).alias("cell")).distinct()
    placed = points.join(cells, "cell", "left_semi").withColumn("part", F.lit(0).cast("long"))
    boxes = cores.select("cell", F.lit(0).cast("long").alias("part"), *BOX).join(cells, "cell", "left_semi")
    pairs = pairs.select("a_cell", F.lit(0).cast("long").alias("a_part"), "b_cell", F.lit(0).cast("long").alias("b_part"))
    place = lambda v: F.least(F.floor((F.col(v) - F.col(f"{v}min")) / F.greatest(F.col(f"{v}max") - F.col(f"{v}min"), float32(1e-30)) * PARTS), F.lit(PARTS - 1))
    edges = None
    while True:
        inside = placed.join(boxes, ["cell", "part"])
        placed = cut(inside.select("cell", (F.col("part") * PARTS * PARTS + place("x") * PARTS + place("y")).cast("long").alias("part"), "x", "y"))
        parts = cut(_parts(placed))
        end = lambda e: parts.select(F.expr(f"part div {PARTS * PARTS}").alias(f"{e}_part"), F.col("part").alias(f"{e}_sub"), *[F.col(c).alias(f"{e}_{c}") for c in parts.columns if c != "part"])  # noqa: B023, E731
        b_box = boxes.select(F.col("cell").alias("b_cell"), F.col("part").alias("b_part"), *[F.col(k).alias(f"c_{k}") for k in BOX])
        one = pairs.join(b_box, ["b_cell", "b_part"]).join(end("a"), ["a_cell", "a_part"]).filter(box_box_distance(_box("a"), _box("c")) <= eps_sq).drop(*[f"c_{k}" for k in BOX])
        both = one.join(end("b"), ["b_cell", "b_part"]).filter(box_box_distance(_box("a"), _box("b")) <= eps_sq)
        judged = cut(_touching(both, eps_sq).drop("a_extremes", "b_extremes"))
        sure = judged.filter("touch").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v")).distinct()
        left = judged.join(sure, (F.col("a_cell") == F.col("u")) & (F.col("b_cell") == F.col("v")), "left_anti").drop("touch", "a_part", "b_part").withColumnsRenamed({"a_sub": "a_part", "b_sub": "b_part"})
        work = F.col("a_n").cast("double") * F.col("b_n")
        found = sure.unionByName(_meeting(left.filter(work <= dense_pairs).drop("a_n", "b_n"), placed, ["cell", "part"], eps_sq))
        edges = cut(found if edges is None else edges.unionByName(found).distinct())
        pairs = left.filter(work > dense_pairs).join(edges, (F.col("a_cell") == F.col("u")) & (F.col("b_cell") == F.col("v")), "left_anti")
        pairs = cut(pairs.select("a_cell", "a_part", "b_cell", "b_part"))
        if pairs.isEmpty():
            return edges
        open_ = pairs.select(F.explode(F.array(F.struct(F.col("a_cell").alias("cell"), F.col("a_part").alias("part")), F.struct(F.col("b_cell").alias("cell"), F.col("b_part").alias("part")))).alias("e")).select("e.*").distinct()
        boxes = cut(parts.select("cell", "part", *BOX).join(open_, ["cell", "part"], "left_semi"))


def cell_edges(marked: DataFrame, cores: DataFrame, params: Params, dense_pairs: int = DENSE_PAIRS) -> DataFrame:
    """u, v: pairs of cells with core points within eps of each other.

    Most pairs are settled by their extreme points, one row for each pair of cells; only the rest is
    expanded, and only to core points that are within eps of the other cell's box. Pairs of dense cells
    are compared by parts before that.
    """
    eps_sq = float32(params.eps_sq)
    judged = _touching(close_pairs(cores, params), eps_sq)
    sure = judged.filter("touch").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v"))
    points = marked.filter("is_core").select("cell", "x", "y")
    unsure = judged.filter("not touch").drop("touch", "a_extremes", "b_extremes")
    largest = cores.agg(F.max("n")).first()[0] or 0
    if largest * largest <= dense_pairs:
        return sure.unionByName(_meeting(unsure, points, ["cell"], eps_sq))
    dense = F.col("a_n").cast("double") * F.col("b_n") > dense_pairs
    return sure.unionByName(_meeting(unsure.filter(~dense), points, ["cell"], eps_sq)).unionByName(_by_parts(unsure.filter(dense), cores, points, eps_sq, max(dense_pairs, 1)))


def cell_components(cores: DataFrame, edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """cell, root for every cell with core points; the root is the component's first cell."""
    found = connected_components(edges, strategy).select(F.col("node").alias("cell"), F.col("component"))
    return cores.select("cell").join(found, "cell", "left").select("cell", F.coalesce("component", "cell").alias("root"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` of cells whose ends have different roots so far."""
    end = lambda e: roots.select(F.col("cell").alias(f"{e}_cell"), F.col("root").alias(f"{e}_root"))
    return pairs.join(end("a"), "a_cell").join(end("b"), "b_cell").filter("a_root <> b_root").drop("a_root", "b_root")


def contracted_components(marked: DataFrame, cores: DataFrame, params: Params, strategy: str = "auto", steps: tuple[int, ...] = STEPS) -> DataFrame:
    """The same as ``cell_components`` over ``cell_edges``, without testing edges that connect nothing.

    Components of the edges that extreme points settle come first. Pairs of cells that are not settled and still lie in
    different components are looked at in steps of rising number of point pairs; each step's edges are
    contracted before the next begins.
    """
    eps_sq = float32(params.eps_sq)
    judged = cut(_touching(close_pairs(cores, params), eps_sq).drop("a_extremes", "b_extremes"))
    edges = judged.filter("touch").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v"))
    left, points = judged.filter("not touch").drop("touch"), marked.filter("is_core").select("cell", "x", "y")
    roots = cut(cell_components(cores, edges, strategy))
    work = F.col("a_n").cast("double") * F.col("b_n")
    least = 0
    while True:
        left = cut(_apart(left.filter(work > least), roots))
        total, largest = left.agg(F.sum(work), F.max(work)).first()
        if not total:
            return roots
        # all that need no parts at once, if they are few; else the first step that isn't empty
        most = next(s for s in (*steps, float("inf")) if s > least)
        if total <= ONE_STEP:
            most = max(most, DENSE_PAIRS if largest > DENSE_PAIRS else largest)
        now = left.filter(work <= most)
        met = _by_parts(now, cores, points, eps_sq) if least >= DENSE_PAIRS else _meeting(now, points, ["cell"], eps_sq)
        # cells stand for what they are connected to
        edges = met.unionByName(roots.filter("cell <> root").select(F.col("cell").alias("u"), F.col("root").alias("v")))
        roots = cut(cell_components(cores, edges, strategy))
        if most >= largest:
            return roots
        least = most


def number_clusters(components: DataFrame, marked: DataFrame, numbering: str = "cell") -> DataFrame:
    """cell, root, cluster: roots are numbered from 0 by cell order, or by the smallest id of a core point."""
    if numbering not in NUMBERINGS:
        raise ValueError(f"numbering must be one of {NUMBERINGS}, not {numbering!r}")
    if numbering == "cell":
        roots = components.select("root").distinct().withColumn("by", F.col("root"))
    else:
        roots = marked.filter("is_core").join(components, "cell").groupBy("root").agg(F.min("id").alias("by"))
    numbered = dense_numbers(roots, "by", "cluster").select("root", "cluster")
    return components.join(numbered, "root").select("cell", "root", "cluster")


def core_labels(marked: DataFrame, clusters: DataFrame) -> DataFrame:
    return marked.filter("is_core").join(clusters.select("cell", F.col("cluster").alias("label")), "cell").select("id", "label")


def border_labels(marked: DataFrame, cores: DataFrame, clusters: DataFrame, params: Params) -> DataFrame:
    """id, label of non-core points within eps of a core point: that of the nearest, the smallest id if tied."""
    others = marked.filter("not is_core").select("id", "x", "y", "kx", "ky")
    boxes = cores.drop("extremes", "n").join(clusters.select("cell", "cluster"), "cell")
    pairs = near_boxes(others, boxes, FULL, params, ["cluster"])
    # the nearest far corner bounds the distance, so that boxes beyond it are dropped before points meet
    each = pairs.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min("reach").alias("bound"), F.collect_list(F.struct("near", "cluster", "low")).alias("boxes"))
    pairs = each.select("id", "x", "y", F.inline(F.filter("boxes", lambda b: b["low"] <= F.col("bound")))).drop("low")
    core = marked.filter("is_core").select(F.col("cell").alias("near"), F.col("id").alias("core"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    reached = pairs.join(core, "near").withColumn("d2", d2).filter(F.col("d2") <= float32(params.eps_sq))
    return reached.groupBy("id").agg(F.min_by("cluster", F.struct("d2", "core")).alias("label"))
