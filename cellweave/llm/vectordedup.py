"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact cosines.

Equal vectors are one node. Unit vectors are turned into binary codes: centred, projected to their principal axes and
rotated so that signs lose least (Gong and Lazebnik, CVPR 2011); several rotations, from different random starts, give
as many bits as the tables need. A table's key is a stretch of bits, about as long as the number of vectors has
digits; how many tables there are follows from how often vectors at the least cosine, made from the fitting
sample, agree in such a stretch. Vectors that share a key meet once, in the first table that they share; codes that
differ too much are dropped, and the rest is judged by the original vectors.

A bucket of many vectors is not compared pair by pair. Its middle is a leader; where two vectors lie so close to one
leader that their angles to it add up to no more than the angle of the least cosine, they are linked, whatever else. Such
links are counted by angles and connected through the vector nearest to the leader. What is left of a large bucket
(vectors far from its leader) meets the bucket's members in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.similar import small
from cellweave.llm.vectorcodes import finite_vectors
from cellweave.operators.components import star_components
from cellweave.plans.lineage import cut

THRESHOLD = 0.95
#: Vectors that the rotations are fitted on (those of least hash), and the bytes that these take at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Bits of a rotation, rounds of its fitting, fewest bits of a key, tables at most, and the share of pairs at the least
#: cosine that the tables are made to find.
BITS, ITERATIONS, LEAST_KEY_BITS, MOST_TABLES, WANTED = 64, 30, 16, 128, 0.95
#: Buckets of more vectors than this have leaders; so many vectors of such a bucket are a block.
HOT, BLOCK = 64, 4096
#: Angles to leaders are rounded up to so many steps between 0 and the largest.
STEPS = 256
#: Pairs worked on at a time.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Coder:
    """Signs of ``(unit vector - mean) @ axes``, in the tables' stretches of ``width`` bits; shorter vectors are filled up with zeros."""

    mean: np.ndarray
    axes: np.ndarray
    width: int
    tables: int
    most_apart: int  #: pairs whose codes differ in more bits are not compared

    def bits(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.axes > 0

    def keys(self, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(rows, tables) keys, each of its table and of vectors of one length only, but for chance."""
        used = bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width)
        value = used.astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))
        salt = (np.arange(self.tables, dtype=np.uint64)[None] + np.uint64(1) + np.uint64(self.tables) * lengths.astype(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        return (value ^ salt).view(np.int64)

    def first_table(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first table in which packed codes agree, bits in which they differ) of the rows of two arrays."""
        differ = np.unpackbits(a ^ b, axis=1, bitorder="little")
        stretches = differ[:, : self.tables * self.width].reshape(len(a), self.tables, self.width)
        return np.argmin(stretches.any(axis=2), axis=1), differ.sum(axis=1, dtype=np.int64)


def units(vectors: list, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, filled up with zeros; lengths)."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), dimensions))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True)), lengths


def rotation(centred: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Axes whose signs are balanced bits: the ``bits`` principal axes, turned so that signs stand for them with least loss."""
    _, vectors = np.linalg.eigh(centred.T @ centred)
    main = vectors[:, ::-1][:, :bits]
    v = centred @ main
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ITERATIONS):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return main @ turn


def fitted(sample: np.ndarray, n: int, threshold: float) -> Coder:
    """A coder for ``n`` vectors from the unit vectors of a sample."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(BITS, sample.shape[1])
    width = max(LEAST_KEY_BITS, math.ceil(math.log2(max(n, 2))))
    # vectors at the least cosine from some of the sample
    rng = np.random.default_rng(7)
    base = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    norms = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    near = threshold * base + math.sqrt(1 - threshold * threshold) * np.divide(noise, norms, out=np.zeros_like(noise), where=norms > 1e-9)
    axes, tables, equal, apart = [], 0, [], []
    missed = np.ones(len(base))
    while tables < MOST_TABLES and missed.mean() > 1 - WANTED:
        axes.append(rotation(centred, bits, len(axes)))
        if len(axes) * bits < (tables + 1) * width:
            continue
        every = np.hstack(axes)
        differ = ((base - mean) @ every > 0) != ((near - mean) @ every > 0)
        tables = min(MOST_TABLES, len(axes) * bits // width)
        equal = ~differ[:, : tables * width].reshape(len(base), tables, width).any(axis=2)
        missed = (~equal.any(axis=1)).astype(float)
        apart = differ.sum(axis=1)
    return Coder(mean, np.hstack(axes), width, tables, int(np.ceil(apart.mean() + 5 * apart.std() + 3)))


def _coded(nodes: DataFrame, coder: Coder) -> DataFrame:
    """node, weight, code, keys of ``nodes``."""
    shared = nodes.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
            u, lengths = units(b.column("embedding").to_pylist(), len(coder.mean))
            bits = coder.bits(u)
            keys = coder.keys(bits, lengths)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, coder.tables), pa.int32()), pa.array(keys.ravel()))
            codes = pa.array([c.tobytes() for c in np.packbits(bits, axis=1, bitorder="little")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), codes, lists], ["node", "weight", "code", "keys"])

    return nodes.select("node", "weight", "embedding").mapInArrow(run, "node long, weight long, code binary, keys array<long>")


def _leaders(coded: DataFrame, nodes: DataFrame, hot: DataFrame, n_hot: int, coder: Coder) -> tuple[DataFrame, DataFrame]:
    """(key, leader, middle: the unit vector of a leader, for the hot keys that are the largest of some vector;
    node, key: the largest hot key of each vector that has one).

    A leader is the middle of a bucket; a bucket whose middle lies in a larger one takes that one's, so a group that
    fills many buckets has one leader.
    """
    place = coded.select("node", F.explode("keys").alias("key")).join(small(hot, n_hot), "key")
    largest = cut(place.groupBy("node").agg(F.max_by("key", F.struct("n", "key")).alias("key")))
    dimensions, one = len(coder.mean), 1 << 30

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
            u, lengths = units(b.column("embedding").to_pylist(), dimensions)
            key, at = np.unique(b.column("key").to_numpy(), return_inverse=True)
            total = np.zeros((len(key), dimensions), np.int64)  # whole numbers, so that the order of rows doesn't matter
            np.add.at(total, at, np.round(u * one).astype(np.int64))
            length = np.zeros(len(key), np.int64)
            length[at] = lengths
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(length), pa.array(total.tolist(), pa.list_(pa.int64()))], ["key", "length", "total"])

    partial = nodes.select("node", "embedding").join(largest, "node").select("key", "embedding").mapInArrow(sums, "key long, length long, total array<long>")
    by_place = partial.select("key", "length", F.posexplode("total").alias("d", "s")).groupBy("key", "d").agg(F.sum("s").alias("s"), F.max("length").alias("length"))
    middles = cut(by_place.groupBy("key").agg(F.max("length").alias("length"), F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"].cast("double")).alias("middle")))
    shared = nodes.sparkSession.sparkContext.broadcast(coder)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for b in batches:
            middle = np.array(b.column("middle").to_pylist()).reshape(b.num_rows, -1)
            norm = np.sqrt((middle * middle).sum(axis=1, keepdims=True))
            u = np.divide(middle, norm, out=np.zeros_like(middle), where=norm > 0)
            keys = coder.keys(coder.bits(u), b.column("length").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(u.tolist(), pa.list_(pa.float64())), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["key", "middle", "keys"])

    found = cut(middles.mapInArrow(keyed, "key long, middle array<double>, keys array<long>"))
    n = found.count()
    sizes = small(cut(found.select("key").join(hot, "key")), n)
    over = found.select("key", F.explode("keys").alias("of")).join(sizes.select(F.col("key").alias("of"), "n"), "of")
    parent = small(cut(over.groupBy("key").agg(F.max_by("of", F.struct("n", "of")).alias("leader"))), n)
    named = found.select("key").join(parent, "key", "left").select("key", F.coalesce("leader", "key").alias("leader"))
    middle = small(found.select(F.col("key").alias("leader"), "middle"), n // 32)  # an array of numbers each
    return named.join(middle, "leader").select("key", "leader", "middle"), largest


def _near_leaders(nodes: DataFrame, leaders: DataFrame, largest: DataFrame, threshold: float, dimensions: int) -> DataFrame:
    """node, weight, leader, step (its angle, rounded up) of the vectors within the largest angle of their leader."""
    most = math.acos(threshold) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
            u, _ = units(b.column("embedding").to_pylist(), dimensions)
            m, _ = units(b.column("middle").to_pylist(), dimensions)
            angle = 2 * np.arcsin(np.minimum(np.sqrt(((u - m) ** 2).sum(axis=1)) / 2, 1))  # exact for small angles too
            step = np.ceil(angle / most * STEPS).astype(np.int32)
            near = pa.array(step <= STEPS)
            yield b.select(["node", "weight", "leader"]).append_column("step", pa.array(step)).filter(near)

    rows = nodes.select("node", "weight", "embedding").join(largest, "node").join(leaders, "key").select("node", "weight", "leader", "embedding", "middle")
    return rows.mapInArrow(run, "node long, weight long, leader long, step int")


class _Rows:
    """Columns of index rows: node, code, leader, step, table, outside."""

    NAMES = ("node", "code", "leader", "step", "table", "outside")

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    @classmethod
    def of(cls, b: pa.RecordBatch) -> _Rows:
        code = b.column("code")
        packed = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(b.num_rows, -1)
        return cls({"code": packed} | {c: b.column(c).to_numpy(zero_copy_only=False) for c in cls.NAMES if c != "code"})

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else cls({c: np.concatenate([p.columns[c] for p in parts]) for c in cls.NAMES})

    def __len__(self) -> int:
        return len(self.columns["node"])

    def take(self, at) -> _Rows:
        return _Rows({c: v[at] for c, v in self.columns.items()})

    def pairs(self, other: _Rows, a: np.ndarray, b: np.ndarray, coder: Coder) -> list[np.ndarray]:
        """u > v of the rows ``a`` here and ``b`` of ``other`` that are first met in this table, not linked through a
        leader, and whose codes are near enough."""
        x, y = self.columns, other.columns
        known = (x["leader"][a] != 0) & (x["leader"][a] == y["leader"][b]) & (x["step"][a] + y["step"][b] <= STEPS)
        a, b = a[~known], b[~known]
        if not len(a):
            return []
        table, apart = coder.first_table(x["code"][a], y["code"][b])
        keep = (table == x["table"][a]) & (apart <= coder.most_apart)
        u, v = x["node"][a[keep]], y["node"][b[keep]]
        return [np.stack([np.maximum(u, v), np.minimum(u, v)])]


def _pair_batches(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        both = np.concatenate(found, axis=1)
        if both.size:
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])


def _small_bucket_pairs(rows: DataFrame, coder: Coder) -> DataFrame:
    """Candidates u, v within buckets of at most ``HOT`` members."""
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def met(key: np.ndarray, r: _Rows, coder: Coder) -> Iterator[pa.RecordBatch]:
        for step in range(1, len(key)):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            for at in range(0, len(same), PAIRS // 8):
                a = same[at : at + PAIRS // 8]
                yield from _pair_batches(r.pairs(r, a, a + step, coder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = np.zeros(0, np.int64), []
        for b in batches:
            key = np.concatenate([keys, b.column("key").to_numpy()])
            r = _Rows.joined([*parts, _Rows.of(b)])
            whole = np.searchsorted(key, key[-1], side="left")  # the last bucket may go on
            yield from met(key[:whole], r.take(slice(0, whole)), shared.value)
            keys, parts = key[whole:], [r.take(slice(whole, None))]
        if parts:
            yield from met(keys, parts[0], shared.value)

    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.select("key", *_Rows.NAMES).mapInArrow(run, "u long, v long")


def _large_bucket_pairs(rows: DataFrame, sizes: DataFrame, n_sizes: int, coder: Coder) -> DataFrame:
    """Candidates u, v within larger buckets (``sizes``: key, n). Vectors around the main leader of a bucket are linked among
    themselves; each of the others meets all members, block by block."""
    inner = F.col("leader").isNotNull() & (F.col("step") * 2 <= STEPS)
    main = rows.filter(inner).groupBy("key", "leader").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("leader", F.struct("c", "leader")).alias("main"))
    marked = rows.join(small(sizes, n_sizes), "key").join(small(cut(main), n_sizes), "key", "left")
    marked = marked.withColumn("outside", ~F.coalesce(inner & (F.col("leader") == F.col("main")), F.lit(False))).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    columns = [*_Rows.NAMES, "key"]
    members = marked.select(*columns, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"))
    visitors = marked.filter("outside").select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"))
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, whole = None, [], None
        for b in batches:
            r = _Rows.of(b)
            key, block, kind = (b.column(c).to_numpy() for c in ("key", "block", "kind"))
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
                if lo == hi:
                    continue
                if (key[lo], block[lo]) != now:
                    now, inside, whole = (key[lo], block[lo]), [], None
                part = r.take(slice(lo, hi))
                if kind[lo] == 0:
                    inside.append(part)
                    continue
                whole = whole or (_Rows.joined(inside) if inside else None)
                if not whole:
                    continue
                few = max(1, PAIRS // 8 // len(whole))
                for at in range(0, len(part), few):
                    x = part.take(slice(at, at + few))
                    a, c = np.repeat(np.arange(len(x)), len(whole)), np.tile(np.arange(len(whole)), len(x))
                    u, v = x.columns["node"][a], whole.columns["node"][c]
                    # two that are outside both come to each other's block
                    ok = (u != v) & (~whole.columns["outside"][c] | (u < v))
                    yield from _pair_batches(x.pairs(whole, a[ok], c[ok], shared.value))

    dealt = members.unionByName(visitors).repartition("key", "block").sortWithinPartitions("key", "block", "kind", "node")
    return dealt.select("key", "block", "kind", *_Rows.NAMES).mapInArrow(run, "u long, v long")


def _judged(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """u, v, u_weight, v_weight of the pairs whose cosine, in double precision, is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
            a, c = (b.column(k).to_pylist() for k in ("a", "c"))
            width = max(map(len, [*a, *c]), default=1)
            (x, n), (y, m) = units(a, width), units(c, width)
            near = ((x * y).sum(axis=1) >= threshold) & (n == m)
            yield b.select(["u", "v", "u_weight", "v_weight"]).filter(pa.array(near))

    end = lambda e, name: nodes.select(F.col("node").alias(e), F.col("embedding").alias(name), F.col("weight").alias(f"{e}_weight"))
    both = pairs.join(end("u", "a"), "u").join(end("v", "c"), "v")
    return both.select("u", "v", "u_weight", "v_weight", "a", "c").mapInArrow(run, "u long, v long, u_weight long, v_weight long")


def vector_links(nodes: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Over ``nodes`` (node bigint, weight bigint, embedding; different, usable vectors, materialised): edges u, v that keep
    all connections, and node, links: the weights of the other nodes that each is linked to."""
    spark = nodes.sparkSession
    n, dimensions = nodes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "node long, links long")
    if n < 2:
        return none
    rows = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dimensions)))
    sample = nodes.orderBy(F.xxhash64("embedding"), "node").select("embedding").limit(rows).toArrow()
    coder = fitted(units(sample["embedding"].to_pylist(), dimensions)[0], n, threshold)
    coded = cut(_coded(nodes, coder))
    index = coded.select("node", "code", F.posexplode("keys").alias("table", "key"))
    large = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    n_large = large.count()
    around = None
    if n_large:
        leaders, largest = _leaders(coded, nodes, large, n_large, coder)
        around = cut(_near_leaders(nodes, leaders, largest, threshold, dimensions))
        index = index.join(around.select("node", "leader", "step"), "node", "left")
    else:
        index = index.withColumns({"leader": F.lit(None).cast("long"), "step": F.lit(None).cast("int")})
    plain = index.select("node", "code", F.coalesce("leader", F.lit(0)).alias("leader"), F.coalesce("step", F.lit(0)).alias("step"), "table", F.lit(False).alias("outside"), "key")
    if n_large:
        at_large = small(large.select("key"), n_large)
        pairs = _small_bucket_pairs(plain.join(at_large, "key", "left_anti"), coder)
        wide = index.join(at_large, "key", "left_semi")
        pairs = pairs.unionByName(_large_bucket_pairs(wide.withColumn("leader", F.coalesce("leader", F.lit(0))).withColumn("step", F.coalesce("step", F.lit(STEPS + 1))), large, n_large, coder))
    else:
        pairs = _small_bucket_pairs(plain, coder)
    links = cut(_judged(pairs, nodes, threshold))
    counted = links.select("u", "v_weight").toDF("node", "links").unionByName(links.select("v", "u_weight").toDF("node", "links"))
    edges = links.select("u", "v")
    if around is not None:
        table = cut(around.groupBy("leader", "step").agg(F.sum("weight").alias("c")))
        other = table.select(F.col("leader").alias("of"), F.col("step").alias("reach"), F.col("c").alias("more"))
        # at most STEPS rows of a leader on either side
        met = table.join(other, (F.col("leader") == F.col("of")) & (F.col("step") + F.col("reach") <= STEPS)).groupBy("leader", "step").agg(F.sum("more").alias("near"))
        own = F.when(F.col("step") * 2 <= STEPS, F.col("weight")).otherwise(0)
        counted = counted.unionByName(around.join(met, ["leader", "step"]).select("node", (F.col("near") - own).alias("links")))
        centre = around.groupBy("leader").agg(F.min(F.struct("step", "node")).alias("least")).select("leader", F.col("least.step").alias("reach"), F.col("least.node").alias("v"))
        stars = around.join(centre, "leader").filter((F.col("step") + F.col("reach") <= STEPS) & (F.col("node") != F.col("v")))
        edges = edges.unionByName(stars.select(F.col("node").alias("u"), "v"))
    return cut(edges), counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links (other rows linked to it), component_id (the smallest id
    reachable, itself included), kept (whether that is its own).

    Rows link if their vectors are found and have a cosine of ``threshold`` or more. Rows whose id or vector is null,
    whose vector is zero or holds a null or non-finite component link with nothing and are kept (a null id's
    component is null). Vectors are compared with those of the same length only. Repeated rows are rows like others,
    linked to each other. An empty table gives no rows. Labels and other columns don't matter.
    """
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), e.alias("embedding"), F.xxhash64(e).alias("h1"), F.xxhash64(F.lit("vector"), e).alias("h2"))
    usable = finite_vectors(rows.filter(F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding"))
    usable = usable.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("vector"), "embedding")})
    # counted before the shuffle, so that a vector that a third of the rows hold is one row for each task
    one = usable.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    nodes = cut(one.withColumn("node", F.monotonically_increasing_id() + 1))
    edges, links = vector_links(nodes, threshold, hot)
    parts = star_components(edges)
    known = nodes.select("node", "h1", "h2", "weight", "first_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = cut(known.join(links, "node", "left").select("h1", "h2", "weight", "first_id", "component", F.coalesce("links", F.lit(0)).alias("links")))
    named = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = known.join(named, "component").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    part = F.col("vec_id").isNotNull() & ~F.exists("embedding", bad)
    out = rows.withColumn("h1", F.when(part, F.col("h1"))).select("vec_id", "h1", "h2").join(found, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
