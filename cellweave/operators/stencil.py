"""The 5 x 5 window of a cell as shifted keys, so that neighbour joins are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.grid import box_box_distance, box_of, pack
from cellweave.params import Params

REACH = 2
FULL = [(dx, dy) for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1)]
OTHERS = [o for o in FULL if o != (0, 0)]
#: One of each opposite pair of offsets.
HALF = [(dx, dy) for dx, dy in OTHERS if dx > 0 or (dx == 0 and dy > 0)]


def shifted(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (with kx, ky) once for each offset, with ``near``: the packed key of the cell there."""
    table = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in offsets])
    out = rows.select("*", F.explode(table).alias("o"))
    return out.select("*", F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), pack(F.col("kx") + F.col("o.dx"), F.col("ky") + F.col("o.dy")).alias("near")).drop("o")


def neighbour_table(cells: DataFrame) -> DataFrame:
    """Pairs of occupied cells in one window: cell, dx, dy, slot (0 to 24, 12 itself), neighbour."""
    slot = ((F.col("dx") + REACH) * (2 * REACH + 1) + F.col("dy") + REACH).cast("int")
    pairs = shifted(cells.select("cell", "kx", "ky"), FULL).withColumn("slot", slot)
    return pairs.join(cells.select(F.col("cell").alias("near")), "near").select("cell", "dx", "dy", "slot", F.col("near").alias("neighbour"))


def close_pairs(cells: DataFrame, params: Params) -> DataFrame:
    """Each unordered pair of different cells in one window whose boxes are within eps.

    Columns of the one end have prefix a_, of the other b_.
    """
    from_ = shifted(cells, HALF)
    a = from_.select(F.col("near"), *[F.col(c).alias(f"a_{c}") for c in cells.columns])
    b = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns])
    boxes = [{k: F.col(f"{end}_{k}") for k in box_of()} for end in "ab"]
    return a.join(b, F.col("near") == F.col("b_cell")).drop("near").filter(box_box_distance(*boxes) <= F.lit(params.eps_sq).cast("float"))
