import numpy as np
import pytest

from cellweave.operators import components
from cellweave.operators.components import connected_components, minimum_labels, star_components
from cellweave.operators.numbering import dense_numbers


def brute(edges):
    parent = {}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        parent.setdefault(u, u), parent.setdefault(v, v)
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def graphs():
    rng = np.random.default_rng(5)
    yield []
    yield [(3, 3), (1, 2)]
    yield [(i, i + 1) for i in range(60)] + [(100, 200), (200, -7)]
    yield [(0, i) for i in range(1, 50)] + [(int(i), int(i) + 1) for i in range(1000, 1030, 2)]
    yield [tuple(map(int, e)) for e in rng.integers(-300, 300, (260, 2))] * 2


@pytest.mark.parametrize("strategy", ["driver", "stars", "auto"])
@pytest.mark.parametrize("edges", list(graphs()), ids=["none", "loop", "path", "hub", "random"])
def test_components_are_minimum_labels(spark, edges, strategy):
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(frame, strategy).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert {k: v for k, v in got.items() if k in want} == want
    assert set(got) - set(want) <= {a for a, b in edges if a == b}


def test_null_ends_are_ignored_and_strategy_is_checked(spark):
    frame = spark.createDataFrame([(1, None), (2, 1), (None, None)], "u long, v long")
    for strategy in ("stars", "driver"):
        assert {(r.node, r.component) for r in connected_components(frame, strategy).collect()} == {(2, 1), (1, 1)}
    with pytest.raises(ValueError, match="strategy"):
        connected_components(frame, "other")


def test_auto_falls_back_to_stars(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    got = connected_components(frame, "auto", max_driver_edges=3).collect()
    assert {r.component for r in got} == {0} and len(got) == 31


@pytest.mark.parametrize("edges", list(graphs())[2:], ids=["path", "hub", "random"])
def test_hubs_are_joined_apart(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "HUB", 3)
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    got = {r.node: r.component for r in star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_dense_numbers_over_ranges(spark):
    values = [7 * i % 1009 - 300 for i in range(1009)]
    frame = spark.createDataFrame([(v, str(v)) for v in values], "by long, __part string").repartition(7)
    for rows_a_task in (10_000, 50):
        got = dense_numbers(frame, "by", "n", rows_a_task)
        assert got.columns == ["by", "__part", "n"]
        assert sorted((r.n, r.by) for r in got.collect()) == list(enumerate(sorted(values)))
    assert dense_numbers(frame.limit(0), "by", "n").count() == 0


def test_labels_in_arrays():
    node, root = minimum_labels(np.array([5, 9, 1]), np.array([7, 7, 2]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {5: 5, 7: 5, 9: 5, 1: 1, 2: 1}


@pytest.mark.parametrize("hub", [3, 100_000], ids=["hubs", "no hubs"])
def test_a_join_round_repeats_no_input_in_its_plan(spark, monkeypatch, hub):
    """Plans of hundreds of nodes took the driver's memory in every round over many edges."""
    monkeypatch.setattr(components, "HUB", hub)
    edges = [(i + 1, i - i % 5) for i in range(0, 200, 2)] + [(900 + i, 3) for i in range(20)]
    pairs = spark.createDataFrame(edges, "u long, v long")
    step = components._round(pairs, 60_000)
    assert step._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 8
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert {r.node: r.component for r in star_components(pairs).collect()} == brute(edges)


def test_forests_of_few_edges_need_no_rounds(spark, monkeypatch):
    """Each task's edges become a forest; a task that holds few at a time sends several."""
    rng = np.random.default_rng(8)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (3000, 2)) if e[0] != e[1]]
    pairs = spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long").repartition(4)
    forest = components.spanning_forest(pairs)
    assert forest.count() <= 4 * 400 and {r.node: r.component for r in star_components(forest).collect()} == brute(edges)
    calls = []
    monkeypatch.setattr(components, "_round", lambda *a: calls.append(1))
    assert {r.node: r.component for r in star_components(pairs).collect()} == brute(edges) and not calls


def test_driver_takes_a_bounded_number_of_edges(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(components, "star_components", lambda edges: calls.append(1) or star_components(edges))
    frame = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    assert {r.component for r in connected_components(frame, "driver", max_driver_edges=3).collect()} == {0} and calls
