"""Connected components of an edge table.

Every strategy names each node's component by the smallest node in it. ``driver`` collects the edges, up to a checked
number. ``stars`` first reduces the edges of each task to a spanning forest, which one more task joins if what is left is
few; otherwise large-star and small-star rounds follow (Kiveris et al., SoCC 2014), each of which is joins and minima
over the edge table, reduced and checkpointed, so a component is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans.lineage import cut, fewer_tasks

#: Above this many edges (16 bytes each) the driver is not used.
MAX_DRIVER_EDGES = 1_000_000
#: Nodes with more edges than this are joined apart from the others.
HUB = 100_000
#: Up to this many edges of forests are joined in one task.
FEW_EDGES = 500_000
#: Edges (16 bytes each) that a task gathers before it reduces them to a forest.
FOREST_EDGES = 1_000_000


def minimum_labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges; whole-array steps only."""
    nodes, inverse = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = inverse[: len(src)], inverse[len(src) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[a], parent[b])
        hooked = parent.copy()
        np.minimum.at(hooked, parent[a], low)
        np.minimum.at(hooked, parent[b], low)
        while True:
            jumped = hooked[hooked]
            if np.array_equal(jumped, hooked):
                break
            hooked = jumped
        if np.array_equal(hooked, parent):
            return nodes, nodes[parent]
        parent = hooked


def _state(edges: DataFrame) -> tuple[int, tuple]:
    """(number of edges, digest of them)."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1_000_003))).first()
    return row[0], tuple(row)


def _with_lowest(edges: DataFrame, degrees: DataFrame, rows: int) -> DataFrame:
    """``edges`` with m of their u, from u, m, n (the edges of u; materialised). Rows of hubs, which are few, don't meet in one task."""
    if rows <= HUB or degrees.filter(F.col("n") > HUB).isEmpty():
        return edges.join(degrees.select("u", "m"), "u")
    hubs = F.broadcast(degrees.filter(F.col("n") > HUB).select("u", "m"))  # 16 bytes for every HUB edges at most
    others = edges.join(hubs.select("u"), "u", "left_anti").join(degrees.filter(F.col("n") <= HUB).select("u", "m"), "u")
    return others.unionByName(edges.join(hubs, "u").select(*others.columns))


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """u > v: for the edges (bigint u, v) of each task, every node with the smallest of its component among them.

    A task holds a bounded number of edges; where its forest alone has more, it is sent on and a new one begun.
    """

    def reduced(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        node, root = minimum_labels(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        return node[node != root], root[node != root]

    def batch(forest: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            parts.append(tuple(b.column(c).to_numpy() for c in ("u", "v")))
            if sum(len(p[0]) for p in parts) >= FOREST_EDGES:
                parts = [reduced(parts)]
                if 2 * len(parts[0][0]) >= FOREST_EDGES:
                    yield batch(parts.pop())
        if parts:
            yield batch(reduced(parts))

    return pairs.select("u", "v").mapInArrow(run, "u long, v long")


def _round(pairs: DataFrame, n: int) -> DataFrame:
    """A large-star and a small-star step, by joins with the lowest neighbour of each node.

    What a step uses more than once is materialised: in one plan the steps would repeat each other's inputs dozens
    of times, and planning and compiling that takes hundreds of MB of the driver.
    """
    few = lambda df: fewer_tasks(df, 2 * n)  # noqa: E731  a star has no more rows than edges have ends
    pairs = few(pairs)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = cut(few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))))
    large = few(_with_lowest(both, lowest, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")).distinct()
    large = cut(few(large))
    least = cut(few(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))))
    linked = few(_with_lowest(large, least, 2 * n))
    return few(linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))).distinct()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: bigint columns u, v. Returns node, component; no driver-side data, checkpointed rounds."""
    pairs = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = cut(spanning_forest(pairs))
    n, before = _state(pairs)
    for _ in range(max_rounds):
        if n <= FEW_EDGES:
            pairs = cut(spanning_forest(pairs.coalesce(1)))  # a component of one forest is one star
            break
        pairs = cut(spanning_forest(fewer_tasks(_round(pairs, n), 2 * n)))
        n, after = _state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(edges: DataFrame, strategy: str = "auto", max_driver_edges: int = MAX_DRIVER_EDGES) -> DataFrame:
    """Component of every node in ``edges`` (bigint u, v): columns node, component (the smallest node).

    ``auto`` and ``driver`` count the edges, and collect them if they are ``max_driver_edges`` at most; more go through
    ``stars``. Empty input gives an empty result; null ends and self-loops are ignored.
    """
    if strategy not in ("auto", "driver", "stars"):
        raise ValueError(f"strategy must be auto, driver or stars, not {strategy!r}")
    if strategy == "stars":
        return star_components(edges)
    kept = cut(edges.filter("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long")))
    if kept.count() > max_driver_edges:
        return star_components(kept)
    table = kept.toArrow()
    node, component = minimum_labels(table["u"].to_numpy(), table["v"].to_numpy())
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(component, pa.int64())}))
