"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Equal vectors are one node with the ids that hold it (only the smallest ``k`` + 1 of them can be among
``k`` nearest). A shard's graph is flat arrays of neighbour positions, one table for each layer. Vectors
get one more component that makes their norms equal, so that largest inner product is nearest. Graphs are
built and searched for blocks of vectors at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.plans.lineage import cut

#: Different vectors in a shard (about 100 MB with its graph at 64 components) and the fewest shards.
SHARD_VECTORS, FEWEST_SHARDS = 60_000, 6
BLOCK = 256


class FlatGraph:
    """A small-world graph over the rows of ``vectors``; ``neighbours[layer]`` is (rows, width), -1 where empty."""

    def __init__(self, vectors: np.ndarray, m: int = 12, ef: int = 64, seed: int = 1):
        x = np.asarray(vectors, dtype=np.float64)
        norms = (x * x).sum(1)
        lift = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.x = np.hstack([x, lift[:, None]]).astype(np.float32)
        self.m, self.ef, n = m, ef, len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(m)).astype(int), 6)
        order = rng.permutation(n)
        self.neighbours = [np.full((n, 2 * m if layer == 0 else m), -1, np.int32) for layer in range(self.level.max(initial=0) + 1)]
        self.entry, done = -1, 0
        while done < n:
            # blocks no larger than what stands, so that each newcomer meets a representative graph
            block = order[done : done + (1 if done == 0 else min(BLOCK, max(1, done)))]
            self._insert(block)
            done += len(block)

    def _far(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """-inner product of each query with its row of ids; infinite where the id is -1."""
        d = -np.einsum("qd,qkd->qk", queries, self.x[ids], optimize=True)
        d[ids < 0] = np.inf
        return d

    def _search(self, queries: np.ndarray, start: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest found from each query's start ids, nearest first: (ids, distances)."""
        table, q = self.neighbours[layer], len(queries)
        seen = np.zeros((q, len(self.x) + 1), bool)  # the last column takes the empty slots
        rows = np.arange(q)[:, None]
        ids = np.full((q, ef), -1, np.int32)
        far = np.full((q, ef), np.inf, np.float32)
        ids[:, : start.shape[1]] = start[:, :ef]
        far[:, : start.shape[1]] = self._far(queries, start[:, :ef])
        seen[rows, start] = True
        open_ = ids >= 0
        active = np.arange(q)
        width = 1 if ef < 8 else 4
        while len(active):
            waiting = np.where(open_[active], far[active], np.inf)
            pick = np.argpartition(waiting, min(width, ef) - 1, axis=1)[:, :width]
            live = np.isfinite(np.take_along_axis(waiting, pick, 1))
            going = live.any(1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            a = active[:, None]
            nodes = np.where(live, ids[a, pick], -1)
            open_[a, pick] = False
            near = np.where((nodes >= 0)[:, :, None], table[nodes], -1).reshape(len(active), -1)
            near[seen[a, near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[a, near] = True
            seen[:, -1] = False
            d = self._far(queries[active], near)
            all_ids, all_far = np.hstack([ids[active], near]), np.hstack([far[active], d])
            all_open = np.hstack([open_[active], near >= 0])
            best = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
            ids[active], far[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_far, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1) & np.isfinite(far[active])
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def _choose(self, centres: np.ndarray, ids: np.ndarray, far: np.ndarray, width: int) -> np.ndarray:
        """Of candidates sorted by distance, those nearer to the centre than to any chosen one; then the nearest others."""
        v = self.x[ids]
        between = -np.einsum("bcd,bed->bce", v, v, optimize=True)
        chosen = np.zeros(ids.shape, bool)
        valid = ids >= 0
        for c in range(ids.shape[1]):
            covered = (chosen & (between[:, c, :] < far[:, c, None])).any(1)
            chosen[:, c] = valid[:, c] & ~covered & (chosen.sum(1) < width)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :width]
        out = np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(ids, best, 1), -1)
        if out.shape[1] < width:
            out = np.hstack([out, np.full((len(out), width - out.shape[1]), -1, np.int32)])
        return out.astype(np.int32)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        start = np.full((len(queries), 1), self.entry, np.int32)
        for layer in range(self.level[self.entry], to, -1):
            start = self._search(queries, start, 4, layer)[0]
        return start

    def _insert(self, block: np.ndarray) -> None:
        if self.entry < 0:
            self.entry = int(block[0])
            return
        top = self.level[self.entry]
        queries = self.x[block]
        start = np.full((len(block), 1), self.entry, np.int32)
        for layer in range(top, -1, -1):
            here = self.level[block] >= layer
            ids, far = self._search(queries, start, self.ef if here.any() else 4, layer)
            if here.any():
                width = self.m
                links = self._choose(queries[here], ids[here], far[here], width)
                # a row of the table may be wider than what a newcomer chooses; the rest is for back links
                self.neighbours[layer][block[here], :width] = links
                self._link_back(block[here], links, layer)
            start = ids[:, :8]
        highest = int(block[np.argmax(self.level[block])])
        if self.level[highest] > top:
            self.entry = highest

    def _link_back(self, block: np.ndarray, links: np.ndarray, layer: int) -> None:
        table = self.neighbours[layer]
        width = table.shape[1]
        to, newcomer = links.ravel(), np.repeat(block, links.shape[1])
        newcomer, to = newcomer[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, newcomer = to[order], newcomer[order]
        targets, begin, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(targets), count.max(initial=0)), -1, np.int32)
        extra[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(begin, count)] = newcomer
        for at in range(0, len(targets), BLOCK):
            t = targets[at : at + BLOCK]
            ids = np.hstack([table[t], extra[at : at + BLOCK]])
            far = self._far(self.x[t], ids)
            keep = np.argsort(far, axis=1, kind="stable")[:, : 2 * width]
            ids, far = np.take_along_axis(ids, keep, 1), np.take_along_axis(far, keep, 1)
            full = (ids >= 0).sum(1) > width
            table[t[~full]] = ids[~full][:, :width]
            if full.any():
                table[t[full]] = self._choose(self.x[t[full]], ids[full], far[full], width)

    def nearest(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """(queries, at most ``ef``) ids, nearest first, -1 where nothing was found; at least ``k`` wide if there are as many."""
        ef = max(ef, k)
        out = []
        for at in range(0, len(queries), BLOCK):
            q = np.asarray(queries[at : at + BLOCK], np.float64)
            q = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
            out.append(self._search(q, self._descend(q, 0), ef, 0)[0][:, :k])
        return np.vstack(out) if out else np.zeros((0, k), np.int32)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: no null, zero or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", e.alias("embedding")).filter("vec_id is not null and embedding is not null")
    return rows.filter(~F.exists("embedding", bad)).filter(F.exists("embedding", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """embedding, ids: each different vector with its ``keep`` smallest ids.

    Batches keep that many ids of a vector before the shuffle, so a vector that a third of the rows
    hold arrives as a few rows for each batch.
    """

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                held.setdefault((np.array(v) + 0.0).tobytes(), []).append(i)
            ids = [sorted(set(x))[:keep] for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x).tolist() for x in held], pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int64()))], ["embedding", "ids"])

    part = rows.mapInArrow(fewer, "embedding array<double>, ids array<long>")
    return part.groupBy("embedding").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int = 128, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its ``k`` nearest other vectors by inner product.

    ``vectors`` and ``queries`` have vec_id and embedding. Rows whose id or vector is null, zero or holds a
    null or non-finite component take no part. Vectors are compared with those of the same length only.
    Repeated rows (one id, one vector) count once. Ties go to the smaller id. Empty tables give no rows.
    """
    rows = usable_vectors(vectors)
    nodes = cut(distinct_vectors(rows, k + 1))
    shards = max(FEWEST_SHARDS, -(-nodes.count() // shard_vectors))
    dim = F.size("embedding")
    placed = nodes.select(dim.alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), "embedding", "ids")
    asked = usable_vectors(queries).distinct().select(dim.alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), "embedding", F.lit(None).cast("array<long>").alias("ids"))
    # a shard's vectors come first and are bounded; its queries stream past the graph in batches
    # and a shard has a task of its own, where all vectors are of one length
    task = F.pmod(F.col("shard") + F.hash("dim"), F.lit(shards)).cast("int")
    stream = placed.unionByName(asked).repartitionById(shards, task).sortWithinPartitions("dim", "shard", "kind", "query_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vecs, ids, graph = None, [], [], None
        for b in batches:
            dims, shard, kind = (b.column(c).to_numpy() for c in ("dim", "shard", "kind"))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(kind)], strict=True):
                if lo == hi:
                    continue
                if (key := (dims[lo], shard[lo])) != current:
                    current, vecs, ids, graph = key, [], [], None
                part = b.slice(lo, hi - lo)
                v = part.column("embedding").flatten().to_numpy().reshape(hi - lo, -1)
                if kind[lo] == 0:
                    vecs.append(v)
                    ids += part.column("ids").to_pylist()
                elif vecs:
                    if graph is None:
                        exact = np.vstack(vecs)
                        graph = FlatGraph(exact)
                    found = graph.nearest(v, k + 1, ef)
                    out = []
                    for q, vector, near in zip(part.column("query_id").to_pylist(), v, found, strict=True):
                        near = near[near >= 0]
                        scores = np.einsum("kd,d->k", exact[near], vector)
                        hits = [(-s, i) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for i in ids[n] if i != q]
                        out += [(q, i, -s) for s, i in sorted(hits)[:k]]
                    cols = list(zip(*out, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = stream.mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
