"""Cell and distance expressions. All stay FLOAT: every literal is cast, since Spark promotes otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_HALF = (1 << 32) - 1


def float32(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def cell_coordinate(v: Column, inv_r: float) -> Column:
    """floor(v * inv_r), a BIGINT."""
    return F.floor(v * float32(inv_r))


def pack(kx: Column, ky: Column) -> Column:
    """One BIGINT per cell, ordered by kx, then by ky as an unsigned 32-bit number."""
    return F.shiftleft(kx, 32).bitwiseOR(ky.bitwiseAND(F.lit(LOW_HALF)))


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (bx - ax) * (bx - ax) + (by - ay) * (by - ay)


def _gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(low_a - high_b, low_b - high_a, float32(0))


def point_box_distance(x: Column, y: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """Squared distance of a point to a box, 0 inside; never above that to a point of the box."""
    dx, dy = _gap(x, x, xmin, xmax), _gap(y, y, ymin, ymax)
    return dx * dx + dy * dy


def point_box_reach(x: Column, y: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """Squared distance of a point to a box's farthest corner; never below that to a point of the box."""
    dx, dy = F.greatest(x - xmin, xmax - x), F.greatest(y - ymin, ymax - y)
    return dx * dx + dy * dy


def box_box_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Squared distance between boxes given by xmin, xmax, ymin, ymax; 0 if they touch."""
    dx = _gap(a["xmin"], a["xmax"], b["xmin"], b["xmax"])
    dy = _gap(a["ymin"], a["ymax"], b["ymin"], b["ymax"])
    return dx * dx + dy * dy


def box_of(alias: str = "") -> dict[str, Column]:
    dot = f"{alias}." if alias else ""
    return {k: F.col(dot + k) for k in ("xmin", "xmax", "ymin", "ymax")}
