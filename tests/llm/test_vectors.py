import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import oracles, vectorcodes, vectordedup
from cellweave.llm.vectorcodes import Codebooks, nearest_entries
from tests.oracle import connect, differences

UNUSABLE = [(9000, None), (9001, [0.5, None] * 4), (9002, [float("nan")] + [1.0] * 7), (9003, [float("inf")] + [1.0] * 7)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The rounds in Python's own whole numbers."""
    whole = [(i, label, [math.floor(4096 * x) for x in v]) for i, label, v in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v: [tuple(v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)]
    vectors = [(i, label, cut(v)) for i, label, v in whole]
    books = [[v[p] for _, _, v in vectors[:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min((d2(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            took = defaultdict(list)
            for _, _, v in vectors:
                took[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(x) // len(took[k]) for x in zip(*took[k], strict=True)) if k in took else e for k, e in enumerate(books[p])]
    out = []
    for i, label, v in vectors:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, label, c, e in out), key=repr)


def test_codes_equal_whole_number_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i) % 3 if i % 7 else None, (rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in rng.permutation(150)]
    rows += [rows[0], (None, 1, [0.25] * 16), (3, 2, [0.0] * 16)]
    frame = spark.createDataFrame([(i, v, label) for i, label, v in rows] + [(i, v and v * 2, 1) for i, v in UNUSABLE], "vec_id long, embedding array<float>, label int")
    for n, extra in ((5, []), (1, [F.lit("x").alias(c) for c in ("code", "error", "slot", "value", "codebooks_sha256")])):
        got = sorted((tuple(r) for r in vectorcodes.compress_vectors(frame.select("*", *extra).repartition(n)).collect()), key=repr)
        assert got == plain_codes(rows)


def test_few_vectors_other_lengths_and_empty_tables(spark):
    rows = [(5, [1.0] * 8, None), (2, [-1.5] * 8, None), (7, [1.0] * 9, 1), (8, [], 1), (9, [1.0] * 16, 1), *[(i, v, 1) for i, v in UNUSABLE]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vectorcodes.compress_vectors(frame).collect()}
    assert got == {2: ("00" * 8, 0, 0), 5: ("01" * 8, 0, 0)}
    for empty in (frame.limit(0), frame.filter("vec_id >= 9000")):
        assert vectorcodes.compress_vectors(empty).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        vectorcodes.compress_vectors(spark.createDataFrame([(1, [1e9] * 8, 1)], frame.schema))


def test_partial_distances_find_the_nearest_entry():
    rng = np.random.default_rng(1)
    for width, k in ((1, 16), (8, 16), (3, 1), (5, 7)):
        x, book = rng.integers(-40, 40, (500, width)), rng.integers(-40, 40, (k, width))
        book[k // 2] = book[0]
        want = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, far = nearest_entries(x, book)
        assert at.tolist() == want.argmin(axis=1).tolist() and far.tolist() == want.min(axis=1).tolist()
    assert [len(v) for v in nearest_entries(np.zeros((0, 3), np.int64), np.ones((2, 3), np.int64))] == [0, 0]


def test_codes_are_decoded_within_their_error(spark):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    rows = vectorcodes.finite_vectors(frame)
    books = vectorcodes.fit_codebooks(rows, parts=4, entries=8, rounds=3)
    assert isinstance(books, Codebooks) and books.entries.shape == (4, 8, 2)
    for r in vectorcodes.decode_vectors(vectorcodes.encode_vectors(rows, books), books).join(frame, "vec_id").collect():
        assert np.sum((np.floor(np.array(r.embedding) * 4096) - np.floor(np.array(r.decoded) * 4096)) ** 2) == r.error


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_itq_near_dedup", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from cellweave.llm import queries

    assert differences(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) == ""
    assert oracles.VECTOR_CODE_SQL


def brute_links(rows, threshold=0.95):
    """{row: other rows linked}, by all pairs; rows are (id, vector)."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for dim in {len(rows[k][1]) for k in ok}:
        at = np.array([k for k in ok if len(rows[k][1]) == dim])
        X = np.array([rows[k][1] for k in at], float)
        X /= np.linalg.norm(X, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(X @ X.T >= threshold), strict=True):
            if a != b:
                near[int(at[a])].add(int(at[b]))
    return near


def near_copies(rng, base, n, low, high):
    """``n`` vectors whose angles to ``base`` are between two cosines'."""
    out = []
    for c in rng.uniform(low, high, n):
        noise = rng.normal(size=len(base))
        noise -= noise @ base * base
        out.append(c * base + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise))
    return out


@pytest.mark.parametrize("hot", [4, 64])
def test_near_duplicates_against_all_pairs(spark, hot):
    """Groups of two to hundreds: within half the angle of their middle, and wider ones of which only some pairs link."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v)
    vectors = [unit(rng.normal(size=32)) for _ in range(500)]
    for n, low, high in ((2, 0.98, 0.99), (9, 0.985, 0.999), (300, 0.985, 0.995), (150, 0.955, 0.99), (60, 0.97, 0.9999)):
        vectors += near_copies(rng, unit(rng.normal(size=32)), n, low, high)
    vectors += [vectors[-1] * 3.0, vectors[0] * 2.0]
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[k].tolist()) for i, k in enumerate(order)]
    rows += [(5000 + i, rows[7][1]) for i in range(5)] + [rows[8]] + [(i, v) for i, v in UNUSABLE] + [(9010, [0.0] * 32), (None, rows[7][1]), (9011, [1.0, 0.0]), (9012, [1.0, 0.01])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.select("*", *[F.lit("x").alias(c) for c in ("h1", "node", "component", "n_links", "weight")])
    got = vectordedup.near_duplicate_vectors(frame.repartition(5), hot=hot).collect()
    assert len(got) == len(rows)
    near = brute_links(rows)
    want = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        want[i].append(len(near[k]))
    links = defaultdict(list)
    for r in got:
        links[r.vec_id].append(r.n_links)
    assert all(a <= b for i in want for a, b in zip(sorted(links[i]), sorted(want[i]), strict=True))  # none below the threshold
    assert sum(map(sum, links.values())) >= 0.97 * sum(map(sum, want.values()))
    component = {r.vec_id: r.component_id for r in got}
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in near:
        for b in near[a]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    wrong = sum(component[i] != least[find(k)] for k, (i, _) in enumerate(rows) if i is not None)
    assert wrong <= 0.01 * len(rows)
    assert component[None] is None and component[9011] == component[9012] == 9011
    for i in (9000, 9001, 9002, 9003, 9010):
        assert links[i] == [0] and component[i] == i
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    one = [(1, [1.0, 2.0])]
    for rows in ([], one, UNUSABLE, [(None, None)]):
        got = vectordedup.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, 0, i, True) for i, _ in rows]
    same = vectordedup.near_duplicate_vectors(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)] + [(95, [-1.0])], schema)).collect()
    assert {(r.n_links, r.component_id) for r in same if r.vec_id < 90} == {(89, 0)} and {r.n_links for r in same if r.vec_id == 95} == {0}


def test_rotation_balances_bits():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(3000, 24)) * np.linspace(0.2, 2, 24) + 1
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    coder = vectordedup.fitted(sample, 3000, 0.95)
    share = coder.bits(sample).mean(axis=0)
    assert coder.width == 16 and abs(share - 0.5).max() < 0.2 and np.abs(share - 0.5).mean() < 0.06
    turned = vectordedup.rotation(sample - sample.mean(axis=0), 24, 0)
    loss = lambda axes: np.abs(np.abs((sample - sample.mean(axis=0)) @ axes) - np.abs((sample - sample.mean(axis=0)) @ axes).mean()).mean()
    plain = np.linalg.eigh((sample - sample.mean(axis=0)).T @ (sample - sample.mean(axis=0)))[1]
    assert np.allclose(turned.T @ turned, np.eye(24)) and loss(turned) < loss(plain)
