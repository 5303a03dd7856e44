"""The clustering call by tiles: one shuffle of the points, then only cells at the tiles' rims.

Tiles are rectangles of cells, from splitters taken of a sample, so that each has about as many points, however these
are spread. A point goes to the tile of its cell and to the tiles within four cells of it; a tile so knows all it needs
for core marks, edges and border points of its own. What tiles have in common are rim cells, whose few
links make the components of the whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.grid import cell_coordinate
from cellweave.operators import tile
from cellweave.operators.components import MAX_DRIVER_EDGES, star_components
from cellweave.operators.numbering import dense_numbers
from cellweave.params import Params
from cellweave.plans.lineage import cut

#: Cells around a tile that its task is given.
HALO = 4
#: Points of a tile, about; the fewest where tiles are made only to use all cores; the most that one task takes.
POINTS, LEAST_POINTS, MOST_POINTS = 50_000, 5_000, 1_000_000
#: Points that splitters are taken from: so many, or ``EACH`` for a tile, but no more than ``MOST_SAMPLE`` (16 bytes each).
SAMPLE, EACH, MOST_SAMPLE = 200_000, 20, 4_000_000
#: Tiles are no narrower than this, in cells.
NARROWEST = 8
POINT, LINK, NAME = range(3)
OUT = "kind int, a long, b long, x float, y float"


class TooDense(Exception):
    """A tile would have more points than a task takes, as cells aren't divided."""


@dataclass(frozen=True)
class Tiles:
    """A tree of splits: at node i, cells with coordinate ``axis[i]`` below ``at[i]`` go to ``low[i]``, others to ``high[i]``; axis -1 is tile ``low[i]``."""

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    where: tuple[tile.Rectangle, ...]

    @classmethod
    def of(cls, kx: np.ndarray, ky: np.ndarray, tiles: int, points_each: float) -> Tiles:
        """Of sampled cell coordinates, each of which stands for so many points: the fullest part is split until there are so many tiles."""
        k = (kx, ky)
        nodes: list[list[int]] = [[-1, 0, 0, 0]]
        parts = [(-len(kx), 0, np.arange(len(kx)), tile.WHOLE)]
        done = []
        while parts and len(parts) + len(done) < tiles:
            _, node, rows, where = heapq.heappop(parts)
            split = cls._split(k, rows)
            if split is None:
                done.append((0, node, rows, where))
                continue
            axis, at = split
            below = k[axis][rows] < at
            nodes[node] = [axis, at, len(nodes), len(nodes) + 1]
            for part, side in ((rows[below], 0), (rows[~below], 1)):
                box = list(where)
                box[2 * axis + 1 - side] = at - 1 if side == 0 else at
                heapq.heappush(parts, (-len(part), len(nodes), part, tuple(box)))
                nodes.append([-1, 0, 0, 0])
        leaves = sorted((*done, *parts), key=lambda p: p[1])
        for number, (_, node, rows, _) in enumerate(leaves):
            if len(rows) * points_each > MOST_POINTS and len(rows) > EACH // 4:
                raise TooDense
            nodes[node] = [-1, 0, number, 0]
        return cls(*np.array(nodes, np.int64).T, tuple(p[3] for p in leaves))

    @staticmethod
    def _split(k: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[int, int] | None:
        if len(rows) < 2:
            return None
        spans = [(int(v[rows].min()), int(v[rows].max())) for v in k]
        for axis in sorted((0, 1), key=lambda a: spans[a][0] - spans[a][1]):
            first, last = spans[axis]
            if last - first + 1 < 2 * NARROWEST:
                return None
            middle = int(np.partition(k[axis][rows], len(rows) // 2)[len(rows) // 2])
            return axis, min(max(middle, first + NARROWEST), last + 1 - NARROWEST)
        return None

    def places(self, kx: np.ndarray, ky: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) for all tiles within ``reach`` cells of each cell."""
        row, node = np.arange(len(kx)), np.zeros(len(kx), np.int64)
        rows, tiles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(row):
            leaf = self.axis[node] < 0
            rows.append(row[leaf])
            tiles.append(self.low[node[leaf]])
            row, node = row[~leaf], node[~leaf]
            k = np.where(self.axis[node] == 0, kx[row], ky[row])
            low, high = k - reach < self.at[node], k + reach >= self.at[node]
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.low[node[low]], self.high[node[high]]])
        return np.concatenate(rows), np.concatenate(tiles)


def tiles_for(points: DataFrame, params: Params, n: int) -> Tiles:
    """Tiles of about ``POINTS`` points, or fewer where that leaves cores idle; raises ``TooDense``."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    wanted = max(-(-n // POINTS), min(2 * cores, -(-n // LEAST_POINTS)), 1)
    if wanted == 1:
        return Tiles.of(np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0)
    sample = min(MOST_SAMPLE, max(SAMPLE, EACH * wanted))
    wanted, share = min(wanted, max(1, MOST_SAMPLE // EACH)), min(1.0, sample / n)
    kx, ky = (cell_coordinate(F.col(c), params.inv_r).alias(f"k{c}") for c in ("x", "y"))
    rows = points if share == 1 else points.sample(fraction=share, seed=11)
    table = rows.select(kx, ky).toArrow()  # about ``sample`` rows of 16 bytes
    return Tiles.of(table["kx"].to_numpy(), table["ky"].to_numpy(), wanted, n / max(table.num_rows, 1))


def solved(points: DataFrame, params: Params, tiles: Tiles) -> DataFrame:
    """kind, a, b, x, y. Points: id, the cell that names its component in its tile (null for noise), coordinates.
    Links: a name and another cell of its component. Names: with the smallest core id."""
    shared = points.sparkSession.sparkContext.broadcast(tiles)  # some 50 bytes for each tile

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_numpy() for c in ("x", "y"))
            row, place = shared.value.places(*tile.cell_coordinates(x, y, params), HALO)
            rows = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *rows.columns], ["tile", "id", "x", "y"])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, x, y = (rows[c].to_numpy() for c in ("id", "x", "y"))
        s = tile.solve(ids, x, y, params, shared.value.where[key[0].as_py()])
        m, links, names = int(s.own.sum()), len(s.links[0]), len(s.names)
        root = pa.array(s.root[s.own], mask=s.root[s.own] == tile.NOISE)
        kind = np.repeat(np.array([POINT, LINK, NAME], np.int32), [m, links, names])
        rest = pa.nulls(links + names, pa.float32())
        columns = [kind, pa.concat_arrays([pa.array(v) for v in (ids[s.own], s.links[0], s.names)]), pa.concat_arrays([root, pa.array(s.links[1]), pa.array(s.first_core)])]
        return pa.table([*map(pa.array, columns), pa.concat_arrays([pa.array(x[s.own]), rest]), pa.concat_arrays([pa.array(y[s.own]), rest])], ["kind", "a", "b", "x", "y"])

    return points.mapInArrow(dealt, "tile int, id long, x float, y float").groupBy("tile").applyInArrow(run, OUT)


def _numbers(rows: DataFrame, numbering: str, strategy: str) -> DataFrame:
    """name, cluster for the names that points have."""
    rim = rows.filter(F.col("kind") != POINT).select("kind", "a", "b")
    if strategy != "stars":
        table = rim.limit(MAX_DRIVER_EDGES + 1).toArrow()  # three numbers a row
        if table.num_rows <= MAX_DRIVER_EDGES:
            kind, a, b = (table[c].to_numpy() for c in ("kind", "a", "b"))
            of = kind == NAME
            nodes, number = tile.numbered(a[of], b[of], (a[~of], b[~of]), numbering)
            return F.broadcast(rows.sparkSession.createDataFrame(pa.table({"name": pa.array(nodes, pa.int64()), "cluster": pa.array(number, pa.int32())})))
    links, names = rim.filter(F.col("kind") == LINK), rim.filter(F.col("kind") == NAME)
    found = cut(star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("name", "component"))
    named = names.select(F.col("a").alias("name"), F.col("b").alias("core")).join(found, "name", "left").withColumn("component", F.coalesce("component", "name"))
    roots = named.groupBy("component").agg((F.min("core") if numbering == "first_core" else F.min("component")).alias("by"))
    every = found.unionByName(named.select("name", "component")).distinct()
    return cut(every.join(dense_numbers(roots, "by", "cluster"), "component").select("name", "cluster"))


def labels_by_tiles(points: DataFrame, params: Params, n: int, numbering: str, strategy: str, unique: bool) -> DataFrame:
    """id, x, y, label of all ``n`` points (checked, but for repeated ids, which are refused if ``unique``); raises ``TooDense``."""
    rows = cut(solved(points, params, tiles_for(points, params, n)))
    of_points = rows.filter(F.col("kind") == POINT)
    if unique and not of_points.groupBy("a").count().filter("count > 1").isEmpty():
        raise ValueError("ids must be unique")
    numbers = _numbers(rows, numbering, strategy)
    joined = of_points.join(numbers, F.col("b") == F.col("name"), "left")
    return joined.select(F.col("a").alias("id"), "x", "y", F.coalesce("cluster", F.lit(-1)).cast("int").alias("label"))
