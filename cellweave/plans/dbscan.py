"""The clustering call: functional form and estimator class."""

from __future__ import annotations

from typing import Union

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import core, grid, labels, tile
from cellweave.params import Params
from cellweave.plans import tiles
from cellweave.plans.lineage import cut
from cellweave.sources.points import check_array, from_numpy

ArrayLike2D = Union[DataFrame, pd.DataFrame, np.ndarray]
#: Arrays of at most so many points, which the driver holds anyway, are labelled there.
ARRAY_POINTS = 200_000
#: Tables of more points, and of their cells, are never broadcast by the plan of joins.
BROADCAST_POINTS = 200_000


class Stages:
    """The stages of one call, each a DataFrame made when first asked for.

    What several stages read is checkpointed: components are found eagerly, so the call is
    not fully lazy, and what follows does not repeat what came before.

    ``n``: the number of points. Spark guesses the size of points and cells from compressed files, so where they are many,
    joins with them are sort-merge joins: a broadcast that looks small may have a hundred MB for the driver to build.
    """

    def __init__(self, points: DataFrame, params: Params, numbering: str = "cell", strategy: str = "auto", n: int = 0):
        self.params, self.numbering, self.strategy, self.n = params, numbering, strategy, n
        self.points = self._shuffled(grid.with_cells(points, params))
        self._made: dict[str, DataFrame] = {}

    def _shuffled(self, df: DataFrame) -> DataFrame:
        return df.hint("merge") if self.n > BROADCAST_POINTS else df

    def _once(self, name: str, make, keep: bool = False) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut(make()) if keep else make()
        return self._made[name]

    @property
    def cells(self) -> DataFrame:
        return self._shuffled(self._once("cells", lambda: grid.cell_table(self.points), keep=True))

    @property
    def marked(self) -> DataFrame:
        return self._once("marked", lambda: core.mark_core(self.points, self.cells, self.params), keep=True)

    @property
    def cores(self) -> DataFrame:
        return self._once("cores", lambda: core.core_cells(self.marked), keep=True)

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: labels.cell_edges(self.marked, self.cores, self.params))

    @property
    def components(self) -> DataFrame:
        return self._once("components", lambda: labels.contracted_components(self.marked, self.cores, self.params, self.strategy))

    @property
    def clusters(self) -> DataFrame:
        return self._once("clusters", lambda: labels.number_clusters(self.components, self.marked, self.numbering), keep=True)

    @property
    def core_labels(self) -> DataFrame:
        return self._once("core_labels", lambda: labels.core_labels(self.marked, self.clusters))

    @property
    def border_labels(self) -> DataFrame:
        return self._once("border_labels", lambda: labels.border_labels(self.marked, self.cores, self.clusters, self.params))

    @property
    def labels(self) -> DataFrame:
        return self._once("labels", lambda: self.core_labels.unionByName(self.border_labels))


def prepare(df: DataFrame, eps, min_samples, id: str = "id", x: str = "x", y: str = "y", numbering: str = "cell", strategy: str = "auto", unique: bool = True) -> Stages:
    params = Params.of(eps, min_samples)
    if numbering not in labels.NUMBERINGS:
        raise ValueError(f"numbering must be one of {labels.NUMBERINGS}, not {numbering!r}")
    points = grid.point_table(df, id, x, y)
    n = grid.check_points(points, params, unique)
    return Stages(points, params, numbering, strategy, n)


STRATEGIES = ("auto", "tiles", "driver", "stars")


def _labels(points: DataFrame, params: Params, numbering: str, strategy: str, unique: bool) -> DataFrame:
    """id, x, y, label of every point: by tiles, or by the plan of joins where one cell is too much for a task."""
    if strategy in ("auto", "tiles"):
        n = grid.check_points(points, params, unique=False)
        try:
            return tiles.labels_by_tiles(points, params, n, numbering, "auto" if strategy == "auto" else "stars", unique)
        except tiles.TooDense:
            strategy = "stars"
    n = grid.check_points(points, params, unique)
    stages = Stages(points, params, numbering, strategy, n)
    found = stages.labels.select(F.col("id").alias("of"), "label")
    return points.join(found, F.col("id") == F.col("of"), "left").select("id", "x", "y", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def dbscan2d(X: ArrayLike2D, eps, min_samples, *, id: str = "id", x: str = "x", y: str = "y", label: str = "label", numbering: str = "cell", strategy: str = "auto", check_unique: bool = True) -> ArrayLike2D:
    """Cluster labels of 2-D float32 points: 0, 1, ... or -1 for noise.

    A DataFrame keeps its columns and gains ``label`` INT; its coordinates must be FLOAT and finite, its ids
    unique. An (N, 2) float32 array gives an int32 array in the same order. ``min_samples`` counts the
    point itself. Labels do not depend on row order or partitioning.

    ``strategy`` "auto" deals points to tiles (``plans.tiles``), and finds components of the cells at their rims on the driver
    if these are few; "tiles" finds those in rounds, whatever their number. "stars" and "driver" take the plan of joins,
    with components in rounds and, for a bounded number of edges, on the driver. Arrays that fit a tile are labelled where they are.
    """
    params = Params.of(eps, min_samples)
    if numbering not in labels.NUMBERINGS:
        raise ValueError(f"numbering must be one of {labels.NUMBERINGS}, not {numbering!r}")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if isinstance(X, np.ndarray):
        if X.ndim != 2 or X.shape[1] != 2:
            raise ValueError(f"X must have shape (N, 2), got {X.shape}")
        if X.dtype != np.float32:
            raise ValueError(f"X must be float32, got {X.dtype}")
        if not len(X):
            return np.zeros(0, np.int32)
        if strategy == "auto" and len(X) <= ARRAY_POINTS:
            check_array(X, params)
            return tile.cluster(np.arange(len(X)), X[:, 0], X[:, 1], params, numbering)
        table = dbscan2d(from_numpy(_session(), X), eps, min_samples, numbering=numbering, strategy=strategy, check_unique=False).select("id", "label").toArrow()
        out = np.empty(len(X), np.int32)
        out[table["id"].to_numpy()] = table["label"].to_numpy()
        return out
    found = _labels(grid.point_table(X, id, x, y), params, numbering, strategy, check_unique)
    own = {id: F.col("id").cast(X.schema[id].dataType), x: F.col("x"), y: F.col("y"), label: F.col("label")}
    kept = [c for c in X.columns if c != label]
    if set(kept) <= set(own):  # the points are all there is
        return found.select(*[own[c].alias(c) for c in (*kept, label)])
    key, value = "__cellweave_id", "__cellweave_label"
    found = found.select(F.col("id").alias(key), F.col("label").alias(value))
    return X.join(found, F.col(id).cast("long") == F.col(key), "left").select(*[F.col(f"`{c}`") for c in kept], F.coalesce(value, F.lit(-1)).cast("int").alias(label))


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class DBSCAN:
    """Estimator form. Parameters are checked in ``fit``; coordinates of other types are cast to float32.

    ``labels_`` has the kind of the input: an int32 array for an array, a Series for a pandas frame, a
    DataFrame (id, label) for a DataFrame.
    """

    def __init__(self, eps=0.5, min_samples=5, *, id: str = "id", x: str = "x", y: str = "y", numbering: str = "cell"):
        self.eps, self.min_samples = float(eps), int(min_samples)
        self.id, self.x, self.y, self.numbering = id, x, y, numbering
        self.labels_ = None

    def fit(self, X: ArrayLike2D, y=None) -> DBSCAN:
        """``y`` is ignored."""
        if isinstance(X, DataFrame):
            cast = X.select(F.col(self.id).alias("id"), F.col(self.x).cast("float").alias("x"), F.col(self.y).cast("float").alias("y"))
            self.labels_ = dbscan2d(cast, self.eps, self.min_samples, numbering=self.numbering).select("id", "label")
        elif isinstance(X, pd.DataFrame):
            columns = [self.x, self.y] if {self.x, self.y} <= set(X.columns) else list(X.columns)
            values = X[columns].to_numpy()
            self.labels_ = pd.Series(dbscan2d(np.asarray(values, np.float32), self.eps, self.min_samples, numbering=self.numbering), index=X.index, name="label")
        else:
            self.labels_ = dbscan2d(np.asarray(X, np.float32), self.eps, self.min_samples, numbering=self.numbering)
        return self

    def fit_predict(self, X: ArrayLike2D, y=None):
        return self.fit(X, y).labels_

