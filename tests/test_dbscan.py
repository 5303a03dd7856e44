import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import cellweave
from cellweave import DBSCAN, dbscan2d
from cellweave.operators import core as core_steps
from cellweave.operators import labels as label_steps
from cellweave.params import Params
from cellweave.operators import stencil, tile
from cellweave.plans import diagnostics, lineage, tiles
from cellweave.plans.dbscan import prepare
from cellweave.sources.points import from_array_column, from_numpy
from tests.brute import brute_labels

f32 = np.float32


def blobs(seed, centers, scale, each):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, scale, (each, 2)) for c in centers]).astype(f32)


def dense7():
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(c, 1.0, (150, 2)) for c in rng.uniform(-4, 4, (8, 2))]).astype(f32)
    rng.shuffle(X)
    return X


def tie_lattice():
    grid = np.array([(x, y) for x in range(-8, 9) for y in range(-8, 9)], f32)
    rng = np.random.default_rng(3)
    X = grid[rng.random(289) < 0.55]
    rng.shuffle(X)
    return X


def moons(n, noise, seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, np.pi, n // 2)
    X = np.vstack([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]])
    return (X + rng.normal(0, noise, X.shape)).astype(f32)


def circles(n, noise, factor, seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 2 * np.pi, n // 2, endpoint=False)
    ring = np.c_[np.cos(t), np.sin(t)]
    X = np.vstack([ring, factor * ring])
    return (X + rng.normal(0, noise, X.shape)).astype(f32)


CASES = {
    "three blobs": (blobs(0, [(0, 0), (10, 0), (0, 10)], 0.3, 200), 1.0, 5),
    "dense overlap": (dense7(), 0.35, 5),
    "ties": (tie_lattice(), 1.0, 4),
    "more ties": (tie_lattice(), 1.5, 6),
    "uniform, negative cells": (np.random.default_rng(1).uniform(-12, 12, (1500, 2)).astype(f32), 0.5, 4),
    "moons": (moons(1000, 0.05, 0), 0.15, 5),
    "circles": (circles(1200, 0.05, 0.5, 0), 0.1, 5),
    "one giant cluster": (np.random.default_rng(0).normal(0, 0.3, (1200, 2)).astype(f32), 0.5, 5),
    "all noise": (np.array([(100 * i, 100 * i) for i in range(20)], f32), 1.0, 2),
    "min_samples over n": (blobs(0, [(0, 0), (10, 0), (0, 10)], 0.3, 10), 1.0, 10_000),
    "every point core": (tie_lattice(), 0.5, 1),
    "copies": (np.repeat(np.array([(0, 0), (3, 3)], f32), [6, 2], axis=0), 0.5, 5),
}


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


@pytest.mark.parametrize("strategy", ["auto", "tiles", "driver"])
@pytest.mark.parametrize("name", CASES)
def test_labels_equal_brute_force(name, strategy):
    X, eps, ms = CASES[name]
    got = dbscan2d(X, eps, ms, strategy=strategy)
    assert got.dtype == np.int32 and np.array_equal(got, brute_labels(X, eps, ms))


@pytest.mark.parametrize("name,clusters,noise", [("dense overlap", 12, 100), ("ties", 11, 80), ("more ties", 5, 73), ("three blobs", 3, 0)])
def test_known_counts(name, clusters, noise):
    X, eps, ms = CASES[name]
    labels = dbscan2d(X, eps, ms)
    assert labels.max() + 1 == clusters and (labels == -1).sum() == noise


@pytest.mark.parametrize("b,clusters", [((1.5, 0.5), 1), ((float(np.nextafter(f32(1.5), f32(2))), 0.5), 2), ((float(np.nextafter(f32(1.5), f32(0))), 0.5), 1)])
def test_eps_is_inclusive_to_the_last_bit(b, clusters):
    X = np.array([(0.5, 0.5)] * 5 + [b] * 5, f32)
    assert dbscan2d(X, 1.0, 5).max() + 1 == clusters


def test_diagonal_corner_two_cells_away():
    X = np.array([(0.7071067690849304,) * 2] * 5 + [(1.4142136573791504,) * 2] * 5, f32)
    assert dbscan2d(X, 1.0, 5).max() + 1 == 2


def test_points_of_one_cell_count_without_a_distance_test():
    X = np.array([(-181.01934814453125,) * 2, (-180.31224060058594,) * 2], f32)
    assert dbscan2d(X, 1.0, 2).tolist() == [0, 0]


def test_border_at_exactly_a_large_eps_keeps_its_cluster():
    X = np.array([(0, 0)] * 4 + [(4096, 0)], f32)
    assert dbscan2d(X, 4096.0, 5).tolist() == brute_labels(X, 4096.0, 5).tolist() == [0] * 5


def test_nearest_core_tie_goes_to_the_smaller_id(spark):
    left, right = [(-1.0, 0.0)] * 4, [(1.0, 0.0)] * 4
    for ids in (range(9), [8, 7, 6, 5, 4, 3, 2, 1, 0]):
        X = np.array(left + right + [(0.0, 0.0)], f32)
        frame = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, X, strict=True)], "id long, x float, y float")
        got = {r.id: r.label for r in dbscan2d(frame, 1.0, 6).collect()}
        want = brute_labels(X, 1.0, 6, list(ids))
        assert got == dict(zip(ids, want.tolist(), strict=True))


def small_tiles(monkeypatch, points=60, narrowest=1):
    for name, value in (("POINTS", points), ("LEAST_POINTS", points), ("NARROWEST", narrowest)):
        monkeypatch.setattr(tiles, name, value)


@pytest.mark.parametrize("block", [40, 1_000_000])
@pytest.mark.parametrize("name", CASES)
def test_tiles_of_few_cells_have_the_labels_of_brute_force(spark, monkeypatch, name, block):
    """Clusters over many tiles, whose cells are no more than a few; pairs of points are compared a few at a time."""
    small_tiles(monkeypatch)
    monkeypatch.setattr(tile, "BLOCK", block)
    X, eps, ms = CASES[name]
    want = brute_labels(X, eps, ms).tolist()
    frame = from_numpy(spark, X)
    for strategy, numbering in (("auto", "cell"), ("tiles", "first_core")):
        want = brute_labels(X, eps, ms, numbering=numbering).tolist()
        got = {r.id: r.label for r in dbscan2d(frame, eps, ms, strategy=strategy, numbering=numbering).collect()}
        assert [got[i] for i in range(len(X))] == want


def test_tiles_divide_the_plane():
    rng = np.random.default_rng(1)
    kx, ky = np.concatenate([rng.integers(-500, 500, 4000), np.full(4000, 7)]), np.concatenate([rng.integers(-90, 90, 4000), np.full(4000, -3)])
    made = tiles.Tiles.of(kx, ky, 40, 1)
    row, place = made.places(kx, ky, 0)
    assert sorted(row.tolist()) == list(range(len(kx))) and len(made.where) > 20
    for r, p in zip(row, place, strict=True):
        x0, x1, y0, y1 = made.where[p]
        assert x0 <= kx[r] <= x1 and y0 <= ky[r] <= y1
    row, place = made.places(kx, ky, 4)
    near = {(r, p) for r, p in zip(row.tolist(), place.tolist(), strict=True)}
    assert len(near) == len(row)
    for p, (x0, x1, y0, y1) in enumerate(made.where):
        inside = np.flatnonzero((kx >= x0 - 4) & (kx <= x1 + 4) & (ky >= y0 - 4) & (ky <= y1 + 4))
        assert {r for r, q in near if q == p} == set(inside.tolist())
    with pytest.raises(tiles.TooDense):
        tiles.Tiles.of(kx, ky, 40, 1000)


def test_a_cell_of_too_many_points_is_left_to_the_plan_of_joins(spark, monkeypatch):
    X, eps, ms = CASES["dense overlap"]
    small_tiles(monkeypatch)
    monkeypatch.setattr(tiles, "MOST_POINTS", 30)
    got = {r.id: r.label for r in dbscan2d(from_numpy(spark, X), eps, ms).collect()}
    assert [got[i] for i in range(len(X))] == brute_labels(X, eps, ms).tolist()


def test_tiles_take_one_shuffle_of_the_points(spark):
    points = from_numpy(spark, CASES["dense overlap"][0])
    params = Params.of(0.35, 5)
    plan = tiles.solved(points, params, tiles.tiles_for(points, params, 1200))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_reach_of_two_sets_of_points(monkeypatch):
    monkeypatch.setattr(tile, "BLOCK", 50)
    rng = np.random.default_rng(2)
    for gap in (0.5, 0.97, 1.0, 1.05, 3.0):
        for n, m in ((1, 900), (700, 600), (300, 1)):
            ax, ay = (-rng.random(n) * 0.7).astype(f32), rng.random(n).astype(f32)
            bx, by = (gap + rng.random(m) * 0.7).astype(f32), rng.random(m).astype(f32)
            dx, dy = bx - ax[:, None], by - ay[:, None]
            assert tile.within_reach(ax, ay, bx, by, f32(1)) == bool((dx * dx + dy * dy <= f32(1)).any())
    same = np.zeros(400, f32)
    assert not tile.within_reach(same, same, same + f32(2), same, f32(1)) and tile.within_reach(same, same, same + f32(1), same, f32(1))


def test_edges_between_cells_that_are_connected_are_not_looked_at(spark, monkeypatch):
    """Where sure edges connect all, no points meet; otherwise pairs meet in steps, and labels stay the same."""
    calls = []
    meeting, by_parts = label_steps._meeting, label_steps._by_parts
    monkeypatch.setattr(label_steps, "_meeting", lambda pairs, *a: calls.append(pairs.count()) or meeting(pairs, *a))
    X = np.array([(i / 20, j / 20) for i in range(40) for j in range(40)], f32)
    stages = prepare(from_numpy(spark, X), 0.5, 5)
    assert stages.components.select("root").distinct().count() == 1 and calls == []
    monkeypatch.setattr(label_steps, "ONE_STEP", 0)
    monkeypatch.setattr(label_steps, "_by_parts", lambda *a: calls.append("parts") or by_parts(*a))
    rng = np.random.default_rng(5)
    strips = [np.c_[k * 0.36 + 0.03 * np.sin(9 * t), t] for k, t in ((k, rng.random(300 + 200 * k) * 2) for k in range(6))]
    X = np.vstack(strips).astype(f32)  # at most eps apart where their waves meet
    stages = prepare(from_numpy(spark, X), 0.32, 3)
    want = sorted(map(tuple, label_steps.cell_components(stages.cores, stages.edges).collect()))
    calls.clear()
    monkeypatch.setattr(label_steps, "DENSE_PAIRS", 20_000)
    found = label_steps.contracted_components(stages.marked, stages.cores, stages.params, "auto", (6_000, 20_000))
    assert sorted(map(tuple, found.collect())) == want and calls


def test_only_undecided_points_meet_points(spark):
    X, eps, ms = CASES["dense overlap"]
    stages = prepare(from_numpy(spark, X), eps, ms)
    bounds = core_steps.bounded_counts(stages.points, stages.cells, stages.params)
    open_ = bounds.filter((F.col("sure") < ms) & (F.col("most") >= ms)).count()
    sparse = stages.points.join(stages.cells.filter(F.col("n") < ms), "cell").count()
    counts = {r.id: r.n_neighbours for r in core_steps.neighbour_counts(stages.points, stages.cells, stages.params).collect()}
    assert all(r.sure <= counts[r.id] <= r.most for r in bounds.collect()) and 0 < open_ < sparse
    reached = {r.id for r in core_steps.reaching_points(stages.points, stages.cells, stages.params).collect()}
    assert reached == {i for i, k in counts.items() if k >= ms}


def test_first_core_numbering():
    X, eps, ms = CASES["dense overlap"]
    assert np.array_equal(dbscan2d(X, eps, ms, numbering="first_core", strategy="driver"), brute_labels(X, eps, ms, numbering="first_core"))
    assert np.array_equal(dbscan2d(X, eps, ms, numbering="first_core"), brute_labels(X, eps, ms, numbering="first_core"))
    with pytest.raises(ValueError, match="numbering"):
        dbscan2d(X, eps, ms, numbering="other")


def test_labels_do_not_depend_on_order_partitions_or_strategy(spark):
    X, eps, ms = CASES["dense overlap"]
    want = brute_labels(X, eps, ms)
    for partitions, strategy in ((1, "driver"), (7, "stars"), (5, "auto"), (3, "tiles")):
        shuffled = from_numpy(spark, X).orderBy("x").repartition(partitions)
        spark.conf.set("spark.sql.shuffle.partitions", str(2 * partitions))
        try:
            got = {r.id: r.label for r in dbscan2d(shuffled, eps, ms, strategy=strategy).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert [got[i] for i in range(len(X))] == want.tolist()


@pytest.mark.parametrize("args,message", [((0.0, 5), "eps"), ((-1, 5), "eps"), ((float("nan"), 5), "eps"), ((float("inf"), 5), "eps"), ((1e-60, 5), "eps"), ((1e-45, 5), "eps"), ((1.0, 0), "min_samples")])
def test_parameters_are_checked(args, message):
    X = np.zeros((3, 2), f32)
    with pytest.raises(ValueError, match=message):
        dbscan2d(X, *args)
    DBSCAN(*args)  # only fit checks
    with pytest.raises(ValueError, match=message):
        DBSCAN(*args).fit(X)


def test_shape_and_type_are_checked(spark):
    with pytest.raises(ValueError, match=r"shape \(N, 2\)"):
        dbscan2d(np.zeros((3, 3), f32), 1.0, 5)
    with pytest.raises(ValueError, match="float32"):
        dbscan2d(np.zeros((3, 2)), 1.0, 5)
    with pytest.raises(ValueError, match="float32"):
        dbscan2d(from_numpy(spark, np.zeros((3, 2))), 1.0, 5)


@pytest.mark.parametrize("rows,message", [([(1, float("nan"), 0.0)], "finite"), ([(1, 0.0, float("inf"))], "finite"), ([(1, None, 0.0)], "finite"), ([(None, 0.0, 0.0)], "null id"), ([(1, 0.0, 0.0), (1, 2.0, 0.0)], "unique"), ([(1, 3e30, 0.0)], "too large")])
def test_points_are_checked(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        dbscan2d(spark.createDataFrame(rows, "id long, x float, y float"), 1.0, 2)


def test_degenerate_inputs(spark):
    assert dbscan2d(np.zeros((0, 2), f32), 1.0, 5).shape == (0,)
    assert dbscan2d(from_numpy(spark, np.zeros((0, 2), f32)), 1.0, 5).collect() == []
    assert dbscan2d(np.array([(1, 2)], f32), 1.0, 1).tolist() == [0]
    assert dbscan2d(np.array([(1, 2)], f32), 1.0, 2).tolist() == [-1]
    X = CASES["three blobs"][0]
    assert np.array_equal(dbscan2d(X[::2], 1.0, 5), dbscan2d(X[::2].copy(), 1.0, 5))


def test_frame_keeps_its_columns(spark):
    frame = from_numpy(spark, CASES["three blobs"][0]).selectExpr("id as key", "x as a", "y as b", "'kept' as near", "1 as cell", "id")
    out = dbscan2d(frame, 1.0, 5, id="key", x="a", y="b", label="cluster")
    assert out.columns == ["key", "a", "b", "near", "cell", "id", "cluster"] and dict(out.dtypes)["cluster"] == "int"
    assert out.count() == 600


def test_estimator_keeps_the_kind_of_its_input(spark):
    X = CASES["three blobs"][0]
    want = brute_labels(X, 1.0, 5)
    model = DBSCAN(1.0, 5.9)
    assert model.labels_ is None and model.min_samples == 5 and (DBSCAN().eps, DBSCAN().min_samples) == (0.5, 5)
    assert model.fit(X, y="ignored") is model and np.array_equal(model.labels_, want)
    assert np.array_equal(DBSCAN(1.0, 5).fit_predict(X.astype(float)), want)
    series = DBSCAN(1.0, 5).fit_predict(pd.DataFrame(X, columns=["x", "y"], index=range(5, 605)))
    assert isinstance(series, pd.Series) and series.index[0] == 5 and np.array_equal(series.to_numpy(), want)
    frame = DBSCAN(1.0, 5).fit_predict(from_numpy(spark, X.astype(float)))
    assert [r.label for r in frame.orderBy("id").collect()] == want.tolist()
    assert cellweave.__version__ and cellweave.ArrayLike2D


def test_array_column(spark):
    frame = spark.createDataFrame([(1, [0.0, 1.0, 9.0]), (2, [0.5, 1.0, 9.0])], "vec_id long, e array<float>")
    assert {r.label for r in dbscan2d(from_array_column(frame, "vec_id", "e"), 1.0, 2).collect()} == {0}


def test_profile_and_debug(spark):
    X, eps, ms = CASES["ties"]
    labels, times = diagnostics.dbscan2d_profile(from_numpy(spark, X), eps, ms)
    assert tuple(times) == diagnostics.STAGES and all(t >= 0 for t in times.values())
    assert [r.label for r in labels.orderBy("id").collect()] == brute_labels(X, eps, ms).tolist()
    tables = diagnostics.dbscan2d_debug(from_numpy(spark, X), eps, ms)
    assert len(tables) == 11 and tables["marked"].count() == 153 and tables["marked"].filter("is_core").count() == 35
    rows = {r.stage: r.n_rows for r in diagnostics.profile_table(from_numpy(spark, X), eps, ms).collect()}
    assert rows["core_mark"] == rows["core_labels"] == 35 and rows["unpermute"] == 153 and rows["cluster_id"] == labels.agg(F.max("label")).first()[0] + 1
    with pytest.raises(ValueError, match="n > 0"):
        diagnostics.dbscan2d_debug(from_numpy(spark, np.zeros((0, 2), f32)), eps, ms)
    with pytest.raises(ValueError, match="eps"):
        diagnostics.dbscan2d_debug(from_numpy(spark, X), 0, ms)


def test_comparisons(spark):
    a = spark.createDataFrame([(i, label) for i, label in enumerate([2, 2, -1, 0, 0, 1])], "id long, label int")
    b = spark.createDataFrame([(i, label) for i, label in enumerate([0, 0, -1, 1, 1, 1])], "id long, label int")
    assert diagnostics.n_clusters(a) == 3 and diagnostics.n_noise(a) == 1
    assert [r.label for r in diagnostics.canonical_labels(a).orderBy("id").collect()] == [0, 0, -1, 1, 1, 2]
    assert diagnostics.disagreement(a, a).first()[0] == 0 and diagnostics.disagreement(a, b).first()[0] == 1
    assert diagnostics.adjusted_rand_index(a, a).first()[0] == 1.0
    # pairs together in both 2, in a 2, in b 4, of 15
    assert diagnostics.adjusted_rand_index(a, b).first()[0] == pytest.approx((2 - 2 * 4 / 15) / (3 - 2 * 4 / 15))
    empty = a.limit(0)
    assert diagnostics.n_clusters(empty) == 0 and diagnostics.n_noise(empty) == 0


@pytest.mark.parametrize("gap", [0.09, 0.0985, 0.2])
def test_two_dense_cells_face_each_other(spark, monkeypatch, gap):
    """20,000 points each, apart by less or more than eps, with ragged faces: the edge is that of all pairs."""
    rng = np.random.default_rng(9)
    side = 0.06
    a = np.c_[-rng.random(20_000) * side, rng.random(20_000) * side]
    b = np.c_[rng.random(20_000) * side + gap, rng.random(20_000) * side]
    a[:, 0] -= 0.01 * np.sin(a[:, 1] * 300) ** 2
    b[:, 0] += 0.01 * np.cos(b[:, 1] * 300) ** 2
    X = (np.vstack([a, b]) + 0.005).astype(f32)
    stages = prepare(from_numpy(spark, X), 0.1, 5)
    monkeypatch.setattr(label_steps, "DENSE_PAIRS", 1_000)
    dense = label_steps.cell_edges(stages.marked, stages.cores, stages.params, 1_000)
    plain = label_steps.cell_edges(stages.marked, stages.cores, stages.params, 10**12)
    deep = label_steps.contracted_components(stages.marked, stages.cores, stages.params, "auto", (10, 1_000))
    assert deep.select("root").distinct().count() == label_steps.cell_components(stages.cores, plain).select("root").distinct().count()
    key = lambda frame: sorted((min(r.u, r.v), max(r.u, r.v)) for r in frame.distinct().collect())
    assert key(dense) == key(plain)


def test_dense_pairs_by_parts_on_all_cases(spark):
    for X, eps, ms in list(CASES.values())[:8]:
        stages = prepare(from_numpy(spark, X), eps, ms)
        key = lambda frame: sorted((min(r.u, r.v), max(r.u, r.v)) for r in frame.distinct().collect())
        assert key(label_steps.cell_edges(stages.marked, stages.cores, stages.params, 0)) == key(stages.edges)


def test_checkpoint_folder_is_named_on_clusters():
    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/folder"}
    assert lineage.ensure_checkpoint_dir(Session()) == "hdfs://shared/folder"


def large_blobs():
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(c, 2.0, (2500, 2)) for c in rng.uniform(-25, 25, (20, 2))]).astype(f32)
    rng.shuffle(X)
    return X


@pytest.mark.parametrize("X,clusters,noise", [(large_blobs(), 27, 897), (np.random.default_rng(0).uniform(-200 * np.sqrt(0.05), 200 * np.sqrt(0.05), (50_000, 2)).astype(f32), 1178, 3694)], ids=["blobs", "uniform"])
def test_fifty_thousand_points_give_the_same_labels_every_time(X, clusters, noise):
    here = dbscan2d(X, 0.5, 5)
    assert (here.max() + 1, (here == -1).sum()) == (clusters, noise)
    assert np.array_equal(here, dbscan2d(X, 0.5, 5))
    for strategy in ("driver", "stars", "tiles"):
        assert np.array_equal(here, dbscan2d(X, 0.5, 5, strategy=strategy))


def test_many_points_and_cells_are_not_broadcast(spark, tmp_path, monkeypatch):
    """What Spark takes for small from a compressed file: 1,200,000 cells were broadcast, which the driver couldn't hold."""
    from cellweave.plans import dbscan

    monkeypatch.setattr(dbscan, "BROADCAST_POINTS", 500)
    spark.range(1000).select("id", (F.col("id") * 100).cast("float").alias("x"), (F.col("id") * 100).cast("float").alias("y")).write.parquet(str(tmp_path / "far"))
    far = spark.read.parquet(str(tmp_path / "far"))
    few = far.filter("id < 400")
    for points, broadcast in ((far, False), (few, True)):
        s = prepare(points, 1.0, 2, strategy="driver")
        plans = [core_steps.mark_core(s.points, s.cells, s.params), stencil.close_pairs(s.cells, s.params)]
        assert all(("BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()) == broadcast for plan in plans)
    assert {r.label for r in dbscan2d(far, 1.0, 2, strategy="driver").collect()} == {-1}
    joined = far.withColumn("x", (F.col("x") / 200).cast("float"))
    assert {r.label for r in dbscan2d(joined.withColumn("y", F.lit(0).cast("float")), 1.0, 2, strategy="driver").collect()} == {0}
