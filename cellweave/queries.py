"""One query for each operator, over the driver's tables, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import core, grid, stencil
from cellweave.params import Params
from cellweave.plans import diagnostics
from cellweave.plans.dbscan import DBSCAN, Stages, dbscan2d, prepare


@dataclass(frozen=True)
class PointSet:
    """A table's id and two coordinates, as Spark and as DuckDB expressions (doubles, cast once)."""

    table: str
    id: str
    x: str
    y: str
    duck_x: str = ""
    duck_y: str = ""
    where: str = "true"

    def read(self, spark: SparkSession, sf_dir: str, kind: str = "float") -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").filter(self.where)
        return rows.select(F.col(self.id).cast("long").alias("id"), F.expr(self.x).cast(kind).alias("x"), F.expr(self.y).cast(kind).alias("y"))

    def sql(self) -> str:
        return f"SELECT CAST({self.id} AS BIGINT) AS id, CAST({self.duck_x or self.x} AS FLOAT) AS x, CAST({self.duck_y or self.y} AS FLOAT) AS y FROM {self.table} WHERE {self.where}"


SETS = {
    "events": PointSet("events", "event_id", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1000000D / 86400D", "value", "(epoch(ts) - 1704067200) / 86400"),
    "orders": PointSet("orders", "o_orderkey", "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) / 1000000D / 86400D - 9131D) / 10D", "o_totalprice / 10000D", "(epoch(o_orderdate) / 86400 - 9131) / 10", "o_totalprice / 10000"),
    "part": PointSet("part", "p_partkey", "cast(p_size as double)", "p_retailprice / 20D", "p_size", "p_retailprice / 20"),
    "customer": PointSet("customer", "c_custkey", "cast(c_nationkey as double)", "c_acctbal / 100D", "c_nationkey", "c_acctbal / 100"),
    "embeddings": PointSet("embeddings", "vec_id", "embedding[0]", "embedding[1]", "embedding[1]", "embedding[2]"),
    "nothing": PointSet("part", "p_partkey", "cast(p_size as double)", "p_retailprice / 20D", "p_size", "p_retailprice / 20", "p_partkey < 0"),
    "far": PointSet("part", "p_partkey", "p_partkey * 100D", "p_partkey * 100D", "p_partkey * 100", "p_partkey * 100"),
}


def _ctes(name: str, eps: float, ms: int, p: str = "") -> str:
    """The whole specification as SQL; ``p`` prefixes the names."""
    k = Params.of(eps, ms)
    inv, sq = f"CAST('{k.inv_r!r}' AS FLOAT)", f"CAST('{k.eps_sq!r}' AS FLOAT)"
    d2 = lambda a, b: f"(({b}.x - {a}.x) * ({b}.x - {a}.x) + ({b}.y - {a}.y) * ({b}.y - {a}.y))"
    return f"""
{p}pts AS MATERIALIZED (SELECT id, x, y, CAST(floor(x * {inv}) AS BIGINT) AS kx, CAST(floor(y * {inv}) AS BIGINT) AS ky FROM ({SETS[name].sql()})),
{p}cells AS MATERIALIZED (SELECT kx, ky, kx * 4294967296 + (ky & 4294967295) AS cell, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM {p}pts GROUP BY kx, ky),
{p}p AS MATERIALIZED (SELECT t.*, c.cell, c.n FROM {p}pts t JOIN {p}cells c USING (kx, ky)),
{p}off AS MATERIALIZED (SELECT a.dx, b.dy FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) b),
{p}sh AS MATERIALIZED (SELECT t.id, t.x, t.y, t.cell, t.n, o.dx, o.dy, t.kx + o.dx AS nkx, t.ky + o.dy AS nky FROM {p}p t, {p}off o),
{p}csh AS MATERIALIZED (SELECT c.*, o.dx, o.dy, c.kx + o.dx AS nkx, c.ky + o.dy AS nky FROM {p}cells c, {p}off o),
{p}cnt AS MATERIALIZED (SELECT s.id, count(*) FILTER (WHERE q.cell = s.cell OR {d2("s", "q")} <= {sq}) AS k FROM {p}sh s JOIN {p}p q ON q.kx = s.nkx AND q.ky = s.nky GROUP BY s.id),
{p}m AS MATERIALIZED (SELECT t.*, c.k, c.k >= {ms} AS is_core FROM {p}p t JOIN {p}cnt c USING (id)),
{p}csha AS MATERIALIZED (SELECT m.id, m.x, m.y, m.cell, m.kx + o.dx AS nkx, m.ky + o.dy AS nky FROM {p}m m, {p}off o WHERE m.is_core AND NOT (o.dx = 0 AND o.dy = 0)),
{p}edges AS MATERIALIZED (SELECT DISTINCT a.cell AS a, b.cell AS b FROM {p}csha a JOIN {p}m b ON b.kx = a.nkx AND b.ky = a.nky WHERE b.is_core AND {d2("a", "b")} <= {sq}),
{p}cc(c, comp) USING KEY (c) AS (
  SELECT DISTINCT cell, cell FROM {p}m WHERE is_core
  UNION
  SELECT e.b, min(u.comp) FROM {p}edges e JOIN {p}cc u ON u.c = e.a JOIN recurring.{p}cc r ON r.c = e.b WHERE u.comp < r.comp GROUP BY e.b),
{p}roots AS MATERIALIZED (SELECT comp, CAST(row_number() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM {p}cc)),
{p}corelab AS MATERIALIZED (SELECT m.id, r.cluster AS label FROM {p}m m JOIN {p}cc ON m.cell = {p}cc.c JOIN {p}roots r ON r.comp = {p}cc.comp WHERE m.is_core),
{p}border AS MATERIALIZED (
  SELECT s.id, arg_min(l.label, {{'d': {d2("s", "q")}, 'i': q.id}}) AS label
  FROM {p}sh s JOIN {p}m t ON t.id = s.id AND NOT t.is_core JOIN {p}m q ON q.kx = s.nkx AND q.ky = s.nky AND q.is_core JOIN {p}corelab l ON l.id = q.id
  WHERE {d2("s", "q")} <= {sq} GROUP BY s.id),
{p}lab AS MATERIALIZED (SELECT t.id, coalesce(c.label, b.label, -1) AS label FROM {p}pts t LEFT JOIN {p}corelab c USING (id) LEFT JOIN {p}border b USING (id))"""


def _sql(select: str, name: str = "events", eps: float = 0.5, ms: int = 5) -> str:
    return f"WITH RECURSIVE {_ctes(name, eps, ms)}\n{select}"


def _stages(name: str = "events", eps: float = 0.5, ms: int = 5, **options) -> Callable[[SparkSession, str], Stages]:
    return lambda spark, sf_dir: prepare(SETS[name].read(spark, sf_dir), eps, ms, **options)


def _of(pick: Callable[[Stages], DataFrame], **options) -> Callable[[SparkSession, str], DataFrame]:
    make = _stages(**options)
    return lambda spark, sf_dir: pick(make(spark, sf_dir))


def _labels(name: str, eps: float, ms: int, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dbscan2d(SETS[name].read(spark, sf_dir), eps, ms, **options).select("id", "label")


#: Tables of the debug form: what stands for their contents, in Spark's and DuckDB's words alike, and the rows in SQL.
_DEBUG = {
    "points": ("id", "pts"),
    "cells": ("n * (cell % 1000003)", "cells"),
    "neighbours": ("(cell % 1000003) * 31 + (neighbour % 1009) * slot", "(SELECT a.cell, (a.dx + 2) * 5 + a.dy + 2 AS slot, b.cell AS neighbour FROM csh a JOIN cells b ON b.kx = a.nkx AND b.ky = a.nky)"),
    "marked": ("CASE WHEN is_core THEN id ELSE 0 END", "m"),
    "cell_status": ("status * (kx % 1009 + 7 * (ky % 1009))", "(SELECT kx, ky, CASE WHEN NOT bool_or(is_core) THEN 0 WHEN bool_and(is_core) THEN 2 ELSE 1 END AS status FROM m GROUP BY kx, ky)"),
    "core_cells": ("n * (cell % 1000003)", "(SELECT cell, count(*) AS n FROM m WHERE is_core GROUP BY cell)"),
    "edges": ("u % 1000003 + v % 1000003", "(SELECT a AS u, b AS v FROM edges WHERE a < b)"),
    "components": ("(cell % 1000003) * 3 + root % 1000003", "(SELECT c AS cell, comp AS root FROM cc)"),
    "clusters": ("(cell % 1000003) * (cluster + 1)", "(SELECT cc.c AS cell, r.cluster FROM cc JOIN roots r ON r.comp = cc.comp)"),
    "core_labels": ("id * (label + 1)", "corelab"),
    "labels": ("id * (label + 1)", "(SELECT * FROM lab WHERE label >= 0)"),
}


def _debug_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n, total: the sizes of the debug form's tables, and sums over their contents."""
    tables = diagnostics.dbscan2d_debug(SETS["events"].read(spark, sf_dir), 0.5, 5)
    counted = [tables[name].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr(total)), F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("name"), "n", "total") for name, (total, _) in _DEBUG.items()]
    return reduce(DataFrame.unionByName, counted)


def _doubles(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*[F.col(c).cast("double").alias(c) if c in columns else c for c in frame.columns])


def _point_box(s: Stages) -> DataFrame:
    sparse = s.points.join(core.full_cells(s.cells, s.params).select("cell"), "cell", "left_anti")
    return core.near_boxes(sparse.select(*s.points.columns), s.cells, stencil.OTHERS, s.params, ["n"]).select("id", F.col("near").alias("cell"))


def _ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.adjusted_rand_index(_labels("events", 0.5, 5)(spark, sf_dir), _labels("events", 0.4, 5)(spark, sf_dir)).select(F.round("ari", 9).alias("ari"))


def _fit_predict(name: str, eps: float, ms: int, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: DBSCAN(eps, ms).fit_predict(SETS[name].read(spark, sf_dir, kind))


_BOX = "CAST(xmin AS DOUBLE) AS xmin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymin AS DOUBLE) AS ymin, CAST(ymax AS DOUBLE) AS ymax"
_SQ = f"CAST('{Params.of(0.5, 5).eps_sq!r}' AS FLOAT)"
_GAP = "greatest({a}.{v}min - {b}.{v}max, {b}.{v}min - {a}.{v}max, CAST(0 AS FLOAT))"
_HALF = "(a.dx > 0 OR (a.dx = 0 AND a.dy > 0))"
_LABELS = "SELECT id, label FROM lab"
_SUMMARY = "SELECT count(*) AS n_points, CAST(coalesce(max(label), -1) + 1 AS BIGINT) AS n_clusters, count(*) FILTER (WHERE label = -1) AS n_noise FROM lab"
_CANON = "{p}canon AS (SELECT l.id, coalesce(f.new, -1) AS label FROM {p}lab l LEFT JOIN (SELECT label, CAST(row_number() OVER (ORDER BY min(id)) - 1 AS INTEGER) AS new FROM {p}lab WHERE label >= 0 GROUP BY label) f USING (label))"


def _two(select: str) -> str:
    return f"WITH RECURSIVE {_ctes('events', 0.5, 5, 'a_')}, {_ctes('events', 0.4, 5, 'b_')}, {_CANON.format(p='a_')}, {_CANON.format(p='b_')}\n{select}"


_ARI_SQL = _two("""SELECT round(CASE WHEN (r + c) / 2 = r * c / t THEN 1 ELSE (s - r * c / t) / ((r + c) / 2 - r * c / t) END, 9) AS ari FROM (
  SELECT (SELECT sum(n * (n - 1) / 2.0) FROM g) AS s, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n)::DOUBLE AS n FROM g GROUP BY p)) AS r,
         (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n)::DOUBLE AS n FROM g GROUP BY q)) AS c, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM g) AS t)""").replace(
    "\nSELECT round", ", g AS (SELECT a.label AS p, b.label AS q, count(*)::DOUBLE AS n FROM a_lab a JOIN b_lab b USING (id) GROUP BY 1, 2)\nSELECT round"
)

#: The rows that each stage makes.
_PROFILE = {
    "cell_keys": "pts",
    "sort_gather": "pts",
    "boundary_scan": "cells",
    "build_ngh": "csh a JOIN cells b ON b.kx = a.nkx AND b.ky = a.nky",
    "core_mark": "m WHERE is_core",
    "union_find": "cc",
    "cluster_id": "roots",
    "core_labels": "corelab",
    "border_assign": "border",
    "unpermute": "pts",
}

#: name: (Spark query, SQL or None)
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "points_projection": (_of(lambda s: _doubles(s.points.select("id", "x", "y"), "x", "y")), _sql("SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pts")),
    "cell_keys": (_of(lambda s: s.points.select("id", "kx", "ky")), _sql("SELECT id, kx, ky FROM pts")),
    "cell_pack_order": (_of(lambda s: s.cells.select("kx", "ky", "cell")), _sql("SELECT kx, ky, cell FROM cells")),
    "cell_counts": (_of(lambda s: s.cells.select("kx", "ky", "n")), _sql("SELECT kx, ky, n FROM cells")),
    "cell_bbox": (_of(lambda s: _doubles(s.cells.select("kx", "ky", "xmin", "xmax", "ymin", "ymax"), "xmin", "xmax", "ymin", "ymax")), _sql(f"SELECT kx, ky, {_BOX} FROM cells")),
    "neighbor_table": (
        _of(lambda s: stencil.neighbour_table(s.cells)),
        _sql("SELECT a.cell, CAST(a.dx AS BIGINT) AS dx, CAST(a.dy AS BIGINT) AS dy, CAST((a.dx + 2) * 5 + a.dy + 2 AS INTEGER) AS slot, b.cell AS neighbour FROM csh a JOIN cells b ON b.kx = a.nkx AND b.ky = a.nky"),
    ),
    "core_full_cells": (_of(lambda s: core.full_cells(s.cells, s.params).select("kx", "ky", "n")), _sql("SELECT kx, ky, n FROM cells WHERE n >= 5")),
    "neighbor_counts": (_of(lambda s: core.neighbour_counts(s.points, s.cells, s.params)), _sql("SELECT id, k AS n_neighbours FROM m WHERE n < 5")),
    "core_points": (_of(lambda s: s.marked.filter("is_core").select("id")), _sql("SELECT id FROM m WHERE is_core")),
    "cell_status": (
        _of(lambda s: core.cell_status(s.marked).select("kx", "ky", "status")),
        _sql("SELECT kx, ky, CAST(CASE WHEN NOT bool_or(is_core) THEN 0 WHEN bool_and(is_core) THEN 2 ELSE 1 END AS INTEGER) AS status FROM m GROUP BY kx, ky"),
    ),
    "box_box_prune": (
        _of(lambda s: stencil.close_pairs(s.cells, s.params).select("a_cell", "b_cell")),
        _sql(f"SELECT a.cell AS a_cell, b.cell AS b_cell FROM csh a JOIN cells b ON b.kx = a.nkx AND b.ky = a.nky WHERE {_HALF} AND {_GAP.format(a='a', b='b', v='x')} * {_GAP.format(a='a', b='b', v='x')} + {_GAP.format(a='a', b='b', v='y')} * {_GAP.format(a='a', b='b', v='y')} <= {_SQ}"),
    ),
    "point_box_prune": (
        _of(_point_box),
        _sql(
            "SELECT s.id, b.cell FROM sh s JOIN cells b ON b.kx = s.nkx AND b.ky = s.nky WHERE s.n < 5 AND NOT (s.dx = 0 AND s.dy = 0) AND "
            "greatest(s.x - b.xmax, b.xmin - s.x, CAST(0 AS FLOAT)) * greatest(s.x - b.xmax, b.xmin - s.x, CAST(0 AS FLOAT)) + "
            f"greatest(s.y - b.ymax, b.ymin - s.y, CAST(0 AS FLOAT)) * greatest(s.y - b.ymax, b.ymin - s.y, CAST(0 AS FLOAT)) <= {_SQ}"
        ),
    ),
    "cell_edges": (_of(lambda s: s.edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))), _sql("SELECT a AS u, b AS v FROM edges WHERE a < b")),
    "cell_components": (_of(lambda s: s.components.select("cell", "root")), _sql("SELECT c AS cell, comp AS root FROM cc")),
    "cell_components_stars": (_of(lambda s: s.components.select("cell", "root"), strategy="stars"), _sql("SELECT c AS cell, comp AS root FROM cc")),
    "cluster_ids": (_of(lambda s: s.clusters.select("root", "cluster").distinct()), _sql("SELECT comp AS root, cluster FROM roots")),
    "core_labels": (_of(lambda s: s.core_labels), _sql("SELECT id, label FROM corelab")),
    "border_assign": (_of(lambda s: s.border_labels), _sql("SELECT id, label FROM border")),
    "dbscan_events": (_labels("events", 0.5, 5), _sql(_LABELS)),
    "dbscan_events_wide": (_labels("events", 1.0, 8, strategy="driver"), _sql(_LABELS, "events", 1.0, 8)),
    "dbscan_orders": (_labels("orders", 0.5, 5), _sql(_LABELS, "orders", 0.5, 5)),
    "dbscan_orders_wide": (_labels("orders", 1.0, 8, strategy="driver"), _sql(_LABELS, "orders", 1.0, 8)),
    "dbscan_part": (_labels("part", 1.0, 3), _sql(_LABELS, "part", 1.0, 3)),
    "dbscan_customer": (_labels("customer", 1.0, 3), _sql(_LABELS, "customer", 1.0, 3)),
    "dbscan_embeddings": (_labels("embeddings", 0.02, 5), _sql(_LABELS, "embeddings", 0.02, 5)),
    "dbscan_stars": (_labels("events", 0.5, 5, strategy="stars"), _sql(_LABELS)),
    "dbscan_tiles": (_labels("orders", 0.5, 5, strategy="tiles"), _sql(_LABELS, "orders", 0.5, 5)),
    "fit_predict_part": (_fit_predict("part", 1.0, 3, "float"), _sql(_LABELS, "part", 1.0, 3)),
    "float64_cast": (_fit_predict("customer", 1.0, 4, "double"), _sql(_LABELS, "customer", 1.0, 4)),
    "first_core_numbering": (
        _labels("events", 0.5, 5, numbering="first_core"),
        _sql("SELECT l.id, coalesce(f.new, -1) AS label FROM lab l LEFT JOIN (SELECT label, CAST(row_number() OVER (ORDER BY min(id)) - 1 AS INTEGER) AS new FROM corelab GROUP BY label) f USING (label)"),
    ),
    "all_noise": (_labels("far", 1.0, 2, strategy="driver"), _sql(_LABELS, "far", 1.0, 2)),
    "min_samples_one": (_labels("customer", 1.0, 1, strategy="driver"), _sql(_LABELS, "customer", 1.0, 1)),
    "min_samples_exceeds_n": (_labels("customer", 1.0, 10_000_000, strategy="driver"), _sql(_LABELS, "customer", 1.0, 10_000_000)),
    "empty_input": (_labels("nothing", 1.0, 5, strategy="driver"), _sql(_LABELS, "nothing", 1.0, 5)),
    "cluster_summary": (lambda spark, sf_dir: diagnostics.cluster_summary(_labels("events", 0.5, 5)(spark, sf_dir)), _sql(_SUMMARY)),
    "canonical_labels": (lambda spark, sf_dir: diagnostics.canonical_labels(_labels("events", 0.5, 5)(spark, sf_dir)), f"WITH RECURSIVE {_ctes('events', 0.5, 5)}, {_CANON.format(p='')}\nSELECT id, label FROM canon"),
    "disagreement": (
        lambda spark, sf_dir: diagnostics.disagreement(_labels("events", 0.5, 5)(spark, sf_dir), _labels("events", 0.4, 5)(spark, sf_dir)),
        _two("SELECT count(*) FILTER (WHERE a.label <> b.label) AS n_different FROM a_canon a JOIN b_canon b USING (id)"),
    ),
    "ari": (_ari, _ARI_SQL),
    "stage_profile": (
        lambda spark, sf_dir: diagnostics.profile_table(SETS["events"].read(spark, sf_dir), 0.5, 5).select("stage", "ordinal", (F.col("ms") > 0).alias("timed"), "n_rows"),
        _sql("SELECT stage, ordinal, true AS timed, n_rows FROM (VALUES " + ", ".join(f"('{s}', {i + 1}, (SELECT count(*) FROM {_PROFILE[s]}))" for i, s in enumerate(diagnostics.STAGES)) + ") AS t(stage, ordinal, n_rows)"),
    ),
    "debug_tables": (
        _debug_tables,
        _sql("\nUNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, CAST(coalesce(sum({total}), 0) AS BIGINT) AS total FROM {rows}" for name, (total, rows) in _DEBUG.items())),
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
