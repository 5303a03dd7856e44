"""Stage timings, intermediate tables, and comparisons of labelings."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import core
from cellweave.operators.numbering import dense_numbers
from cellweave.operators.stencil import neighbour_table
from cellweave.plans.dbscan import prepare
from cellweave.plans.lineage import cut

STAGES = ("cell_keys", "sort_gather", "boundary_scan", "build_ngh", "core_mark", "union_find", "cluster_id", "core_labels", "border_assign", "unpermute")


def _profiled(df: DataFrame, eps, min_samples, options: dict) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    """(labels as id, label; (milliseconds, rows) by stage). A stage's result is written once, and the next reads that."""
    stages = prepare(df, eps, min_samples, **options)
    took: dict[str, tuple[float, int]] = {}

    def run(name: str, make) -> DataFrame:
        began = time.perf_counter()
        made = make()
        made = made if isinstance(made, tuple) else (made, made)
        result = cut(made[0])
        ms = 1000 * (time.perf_counter() - began)
        took[name] = ms, (result if made[0] is made[1] else made[1]).count()  # not part of the time
        return result

    stages.points = run("cell_keys", lambda: stages.points)
    stages.points = run("sort_gather", lambda: stages.points.repartition("cell").sortWithinPartitions("cell"))
    run("boundary_scan", lambda: stages.cells)
    run("build_ngh", lambda: neighbour_table(stages.cells))
    run("core_mark", lambda: (stages.marked, stages.marked.filter("is_core")))
    run("union_find", lambda: stages.components)
    run("cluster_id", lambda: (stages.clusters, stages.clusters.select("cluster").distinct()))
    inner = run("core_labels", lambda: stages.core_labels)
    border = run("border_assign", lambda: stages.border_labels)
    label = F.coalesce("label", F.lit(-1)).cast("int").alias("label")
    out = run("unpermute", lambda: stages.points.select("id").join(inner.unionByName(border), "id", "left").select("id", label))
    return out, took


def dbscan2d_profile(df: DataFrame, eps, min_samples, **options) -> tuple[DataFrame, dict[str, float]]:
    """(labels as id, label; milliseconds by stage) of the plan of joins. Stages don't overlap: what one has made is written,
    and read by the next."""
    out, took = _profiled(df, eps, min_samples, options)
    return out, {name: ms for name, (ms, _) in took.items()}


def profile_table(df: DataFrame, eps, min_samples, **options) -> DataFrame:
    """stage, ordinal, ms, n_rows (that the stage makes; of core marks the core points, of cluster ids the clusters): ten rows."""
    _, took = _profiled(df, eps, min_samples, options)
    return df.sparkSession.createDataFrame([(s, i + 1, *took[s]) for i, s in enumerate(STAGES)], "stage string, ordinal int, ms double, n_rows long")


def dbscan2d_debug(df: DataFrame, eps, min_samples, **options) -> dict[str, DataFrame]:
    """Intermediate tables by name; an empty input is refused."""
    stages = prepare(df, eps, min_samples, **options)
    if stages.points.isEmpty():
        raise ValueError("debug requires n > 0")
    return {
        "points": stages.points,
        "cells": stages.cells,
        "neighbours": neighbour_table(stages.cells),
        "marked": stages.marked,
        "cell_status": core.cell_status(stages.marked),
        "core_cells": stages.cores,
        "edges": stages.edges,
        "components": stages.components,
        "clusters": stages.clusters,
        "core_labels": stages.core_labels,
        "labels": stages.labels,
    }


def n_clusters(labels: DataFrame, label: str = "label") -> int:
    return labels.agg(F.coalesce(F.max(label), F.lit(-1)) + 1).first()[0]


def n_noise(labels: DataFrame, label: str = "label") -> int:
    return labels.agg(F.count_if(F.col(label) == -1)).first()[0]


def cluster_summary(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: n_points, n_clusters, n_noise."""
    return labels.agg(F.count(F.lit(1)).alias("n_points"), (F.coalesce(F.max(label), F.lit(-1)) + 1).cast("long").alias("n_clusters"), F.count_if(F.col(label) == -1).alias("n_noise"))


def canonical_labels(labels: DataFrame, id: str = "id", label: str = "label") -> DataFrame:
    """id, label renumbered from 0 by the smallest id of each cluster; noise stays -1."""
    firsts = labels.filter(F.col(label) >= 0).groupBy(label).agg(F.min(id).alias("first_id"))
    numbered = dense_numbers(firsts, "first_id", "new").select(F.col(label).alias("old"), "new")
    return labels.join(numbered, F.col(label) == F.col("old"), "left").select(id, F.coalesce("new", F.lit(-1)).cast("int").alias(label))


def disagreement(a: DataFrame, b: DataFrame, id: str = "id", label: str = "label") -> DataFrame:
    """One row, n_different: ids whose canonical labels differ."""
    left, right = canonical_labels(a, id, label), canonical_labels(b, id, label).withColumnRenamed(label, "other")
    return left.join(right, id).agg(F.count_if(F.col(label) != F.col("other")).alias("n_different"))


def adjusted_rand_index(a: DataFrame, b: DataFrame, id: str = "id", label: str = "label") -> DataFrame:
    """One row, ari, from the contingency table; noise counts as one group. 1 for identical labelings."""
    joined = a.select(id, F.col(label).alias("p")).join(b.select(id, F.col(label).alias("q")), id)
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    counts = joined.groupBy("p", "q").agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = counts.agg(pairs(F.col("n")).alias("both"), F.sum("n").alias("total"))
    rows = counts.groupBy("p").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("rows"))
    columns = counts.groupBy("q").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("columns"))
    one = both.crossJoin(rows).crossJoin(columns)  # three single rows
    expected = F.col("rows") * F.col("columns") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("rows") + F.col("columns")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))
