"""All links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from an exact prefix filter (Bayardo et al., WWW 2007; Xiao et al., WWW 2008). The shingles of
all texts are counted, each text lists its shingles rarest first, and texts so similar must share one of the
first ones: with the place it stands at, each says up to which size another text may have it in common. Any
order of the shingles gives all links; the rare ones first keep what many texts share out of the lists. The
number of listed shingles that two texts share bounds what they can have in common, before they are compared.

A shingle listed by many texts is not expanded into pairs. The text of smallest id is compared with the
others, and what this leaves outside the most frequent component with the members of other components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from cellweave.llm.exprs import TEXTS, small_batches
from cellweave.operators.components import star_components
from cellweave.plans.lineage import cut, fewer_tasks

#: Shingle length; the least similarity is 4/5, which the sizes and places below are worked out for.
SHINGLE, SIMILARITY = 5, 0.8
#: Lists of a shingle with more members than this are not expanded into pairs.
BUCKET = 24
#: Shingles that are ranked by how often they occur, the most frequent ones; others count as rare.
MAX_RANKED = 500_000
#: Shingles that one counting task holds (about 50 bytes each), and those a worker gathers before it sends them.
COUNTED, GATHERED = 500_000, 500_000
#: Candidates of a text that the first round checks, and how many times more each later round does.
FIRST_CHECKS, MORE_CHECKS = 16, 8
#: About as many pairs of the members of large lists are looked at in a round, and as many members in a block.
PAIRS_A_ROUND, BLOCK = 50_000_000, 2048
#: Pairs that take one text from the same row of it: a text in more pairs is sent in several rows.
PAIRS_OF_A_ROW = 64
#: Numbers that may be broadcast: so many ids, or fewer rows of several numbers, which the driver builds a table of.
BROADCAST_IDS = 200_000
ROWS_PER_TASK = 50_000


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: A-Z and ASCII white space only


def shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    """Shingles of ``k`` words, repeats included; the whole sequence of fewer words; none without words."""
    if k == 1 or not words:
        return words
    line = b" ".join(words)
    if len(words) <= k:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    return [line[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]


def similarity(a: bytes | None, b: bytes | None) -> float:
    """Jaccard similarity of two texts' sets of five-word shingles; 1 if neither has a word."""
    x, y = (set(shingles(words(t))) for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def hashes(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles."""
    import xxhash

    found = set(map(xxhash.xxh3_64_intdigest, shingles(words(text))))
    out = np.fromiter(found, np.uint64, len(found))
    out.sort()
    return out


def set_digest(text: bytes | None) -> list[int]:
    """Two signed numbers that texts with the same set of shingles share."""
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(hashes(text).tobytes()), ">i8").tolist()


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """The counting bucket of each hash and, below it, 32 of its bits."""
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _planes(sorted_values: np.ndarray) -> bytes:
    """Steps between sorted 32-bit values, byte by byte, which the shuffle's compression shortens."""
    steps = np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32)


def shingle_counts(texts: DataFrame, buckets: int, least: int) -> DataFrame:
    """code, n of the shingles in more than ``least`` of the ``texts`` (column text, binary).

    Workers send what they counted in packed rows, one for each bucket of the hash space, so that a shingle
    costs a few bytes of shuffle and a shingle of many texts no more than others.
    """

    def sent(gathered: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(_codes(np.concatenate(gathered), buckets), return_counts=True)
        bucket = (codes >> np.uint64(32)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(codes)]
        spans = list(zip(edges, edges[1:], strict=False))
        low, n = codes.astype(np.uint32), n.astype("<u4")
        rows = [bucket[edges[:-1]].tolist(), [_planes(low[a:b]) for a, b in spans], [n[a:b].tobytes() for a, b in spans]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for b in batches:
            for text in b.column("text"):
                h = hashes(text.as_py())
                if len(h):
                    gathered.append(h)
                    size += len(h)
                if size >= GATHERED:
                    yield sent(gathered)
                    gathered, size = [], 0
        if gathered:
            yield sent(gathered)

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low = np.concatenate([_values(x.as_py()) for x in table["low"]])
        part = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["n"]])
        order = np.argsort(low, kind="stable")
        low, part = low[order], part[order].astype(np.int64)
        first = np.flatnonzero(np.diff(low, prepend=low[:1] + np.uint32(1)))
        n = np.add.reduceat(part, first)
        code = (np.int64(key[0].as_py()) << 32) | low[first].astype(np.int64)
        return pa.table([pa.array(code[n > least]), pa.array(n[n > least])], ["code", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, low binary, n binary").groupBy("bucket").applyInArrow(added, "code long, n long")


def ranking(texts: DataFrame, bucket: int, max_ranked: int = MAX_RANKED) -> tuple[tuple[int, np.ndarray, np.ndarray], bool]:
    """(counting buckets, sorted codes, counts) of the shingles of most texts, ``max_ranked`` at most, and
    whether those are all in more than ``bucket`` texts."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // (6 * COUNTED)))
    counted = cut(shingle_counts(texts, buckets, bucket))
    scale = F.floor(8 * F.log2("n")).cast("int")
    level, kept = 0, 0
    for at, rows in sorted(counted.groupBy(scale.alias("at")).count().collect(), reverse=True):  # 500 rows at most
        if kept + rows > max_ranked:
            level = at + 1
            break
        kept += rows
    table = counted.filter(scale >= level).toArrow()  # at most max_ranked rows
    code, n = table["code"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(code)
    return (buckets, code[order], n[order]), not level


def listed(h: np.ndarray, buckets: int, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, largest size; negative if the shingle is ranked) of the shingles that a text of the hashes ``h`` lists.

    A text of s shingles and one of m, 0.8 similar, have 4/9 (s + m) in common at least. So the first they share
    stands at a place p with s - p as large, in both: m is (5 s - 9 p) / 4 at most. Beyond s / 5 none is left.
    """
    count = np.zeros(len(h), np.int64)
    if len(code):
        own = _codes(h, buckets).astype(np.int64)
        at = np.minimum(np.searchsorted(code, own), len(code) - 1)
        found = code[at] == own
        count[found] = n[at[found]]
    first = np.lexsort((h, count))[: len(h) // 5 + 1] if len(h) else np.zeros(0, np.int64)
    most = (5 * len(h) - 9 * np.arange(len(first))) // 4
    return h[first], np.where(count[first] > 0, -most, most)


def _lists(texts: DataFrame, ranks: tuple[int, np.ndarray, np.ndarray], mark: Callable[[bytes | None], int]) -> DataFrame:
    """id, its mark, k1, k2, n, how many listed shingles are ranked, and the arrays keys, most of every text (id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)  # 16 bytes for each ranked shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in (x.slice(at, TEXTS) for x in batches for at in range(0, x.num_rows, TEXTS)):
            sets = [hashes(t.as_py()) for t in b.column("text")]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), ">i8").astype(np.int64).reshape(-1, 2)
            lists = [listed(h, *shared.value) for h in sets]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in lists])]), pa.int32())
            joined = [np.concatenate([np.zeros(0, t), *(x[i].astype(t) for x in lists)]) for i, t in enumerate((np.uint64, np.int32))]
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (joined[0].view(np.int64), joined[1])]
            marks = pa.array([mark(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), marks, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(h) for h in sets], pa.int32()), pa.array([int((x[1] < 0).sum()) for x in lists], pa.int32()), *arrays], ["id", "mark", "k1", "k2", "n", "ranked", "keys", "most"])

    return texts.mapInArrow(run, "id long, mark long, k1 long, k2 long, n int, ranked int, keys array<long>, most array<int>")


def _met(rows: DataFrame, bucket: int) -> DataFrame:
    """Of rows key, id, sizes (of the set, and of its ranked listed shingles), most, sorted by key: the rows of large
    lists and of ranked shingles (most negative) with u null, and of small lists a row for each pair u, v of members:
    how many listed shingles of this task they ``share``, how many they ``need``, whether a place ``fits``.

    A list holds the first n // 5 + 1 of n shingles. Of two texts, the one whose list ends at the rarer shingle has
    all else that they share outside its list; so they have no more in common than the shared listed ones
    and what is outside the longer list.
    """
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("share", pa.int32()), ("need", pa.int32()), ("fits", pa.bool_())])

    def batch(**columns: np.ndarray) -> pa.RecordBatch:
        k = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    def out(cols: list[np.ndarray], last: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        key = cols[0]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        end = len(key) if last or not len(key) else starts[-1]
        rest = [c[end:] for c in cols]
        key, ids, sizes, most = (c[:end] for c in cols)
        if not end:
            return [], rest
        starts = starts[starts < end]
        size = np.diff(np.append(starts, end))
        large = np.repeat(size > bucket, size) | (most < 0)
        made = []
        if large.any():
            made.append(batch(key=key[large], id=ids[large], n=sizes[large] >> 32, most=np.abs(most[large])))
        key, ids, sizes, most = (c[~large] for c in (key, ids, sizes, most))
        n, ranked = sizes >> 32, sizes & 0xFFFFFFFF
        found = [np.zeros((0, 4), np.int64)]
        for step in range(1, bucket):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            a, b = same, same + step
            alike = (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (ids[a] != ids[b])
            a, b = a[alike], b[alike]
            fits = (n[a] <= most[b]) & (n[b] <= most[a])
            need = -(-4 * (n[a] + n[b]) // 9) - np.maximum(n[a] - n[a] // 5, n[b] - n[b] // 5) + 1 - np.minimum(ranked[a], ranked[b])
            found.append(np.stack([np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), need, fits], axis=1))
        pairs = np.concatenate(found)
        if len(pairs):
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            first = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]))
            share = np.diff(np.append(first, len(pairs)))
            made.append(batch(u=pairs[first, 0], v=pairs[first, 1], share=share, need=np.minimum.reduceat(pairs[:, 2], first), fits=np.maximum.reduceat(pairs[:, 3], first).astype(bool)))
        return made, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for b in batches:
            waiting.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "sizes", "most")])
            if sum(len(w[0]) for w in waiting) >= ROWS_PER_TASK:
                made, rest = out([np.concatenate(x) for x in zip(*waiting, strict=True)], False)
                waiting = [rest]
                yield from made
        if waiting:
            yield from out([np.concatenate(x) for x in zip(*waiting, strict=True)], True)[0]

    return rows.mapInArrow(run, "key long, id long, n int, most int, u long, v long, share int, need int, fits boolean")


def _numbers(kind: DataType) -> int:
    """Numbers in a value of a type; those of a struct count one by one."""
    return sum(_numbers(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else 1


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to join with: broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def small_table(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of rows of several numbers: broadcast if the numbers in its counted rows are few."""
    return small(df, rows * _numbers(df.schema))


def _with_text(pairs: DataFrame, rows: int, texts: DataFrame, end: str, name: str) -> DataFrame:
    """``pairs`` (so many rows) with the text of one end; a text in many pairs is sent in several rows, so that no task has them all."""
    many = pairs.groupBy(end).count().filter(F.col("count") > PAIRS_OF_A_ROW).select(end, F.ceil(F.col("count") / PAIRS_OF_A_ROW).cast("int").alias("copies"))
    many = small_table(many, rows // PAIRS_OF_A_ROW)  # no more texts than that are in so many pairs
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(many, end, "left").withColumn("part", F.pmod(F.hash("u", "v"), copies)).drop("copies")
    sent = texts.withColumnRenamed("id", end).join(many, end, "left").select(end, F.col("text").alias(name), F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    return dealt.join(sent, [end, "part"]).drop("part")


def _checked(pairs: DataFrame, rows: int, texts: DataFrame) -> DataFrame:
    """The pairs u, v whose whole texts (id, text) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holds = [similarity(x.as_py(), y.as_py()) >= SIMILARITY for x, y in zip(b.column("a"), b.column("b"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(holds, pa.bool_()))

    both = _with_text(_with_text(pairs, rows, texts, "u", "a"), rows, texts, "v", "b")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _settled(comps: DataFrame | None, unsure: DataFrame, texts: DataFrame, once: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, component) over ``comps`` (None: no links yet) and those of the unsure pairs that hold; with ``once`` the
    pairs that are left after the first round too.

    A round checks a few pairs of each text; pairs whose ends are in one component by then need no check.
    So a group of many similar texts costs a few checks for each of them, and none that matters is left out.
    """
    end = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}"))
    left, checks = unsure, FIRST_CHECKS
    while True:
        apart = left if comps is None else left.join(end("u"), "u", "left").join(end("v"), "v", "left").filter(F.coalesce("in_u", "u") != F.coalesce("in_v", "v"))
        turn = F.row_number().over(Window.partitionBy("u").orderBy("v"))
        ranked = cut(apart.select("u", "v", turn.alias("turn")))
        now = ranked.filter(F.col("turn") <= checks).select("u", "v")
        rows = now.count()
        if not rows:
            return comps, None
        held = cut(_checked(now, rows, texts))
        if not held.isEmpty():
            comps = star_components(held if comps is None else held.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        left, checks = ranked.filter(F.col("turn") > checks).select("u", "v"), checks * MORE_CHECKS
        if once:
            return comps, left


def _promising(pairs: DataFrame, rows: int, lists: DataFrame) -> DataFrame:
    """The pairs u, v (so many rows) that share enough of what they list (id, keys, n) to be similar.

    What two texts have in common is in both lists, or outside the list that ends at the rarer shingle: no more than what is
    outside the shorter list of the two. Where that and the shared listed shingles are less than 4/9 of both sizes, the
    texts needn't be compared. Only lists, a fifth of the shingles, are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = (np.frombuffer(k.as_py(), np.int64) for k in (x, y))
                n, m = int(x[0]), int(y[0])
                outside = max(n - len(x) + 1, m - len(y) + 1)
                need = -(-4 * (n + m) // 9) - outside
                keep.append(5 * min(n, m) >= 4 * max(n, m) and (need <= 0 or len(np.intersect1d(x[1:], y[1:], assume_unique=True)) >= need))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.concatenate([[n], k.values.to_numpy()]).astype(np.int64).tobytes() for n, k in zip(b.column("n").to_pylist(), b.column("keys"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(each, pa.binary())], ["id", "text"])

    sent = lists.select("id", "n", "keys").mapInArrow(packed, "id long, text binary")
    both = _with_text(_with_text(pairs, rows, sent, "u", "a"), rows, sent, "v", "b")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _ends(u: Column, v: Column) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _grown(comps: DataFrame | None, left: DataFrame | None, large: DataFrame, texts: DataFrame, lists: DataFrame | None) -> DataFrame | None:
    """node, component over ``comps`` (None: no links), the pairs ``left`` that hold, and all that holds within large
    lists (key, id, n, most). Pairs of these are first held against the whole ``lists`` (None: an id may have several).

    In a large list, whatever is outside its most frequent component is compared with the members of other
    components that sizes and places allow. Where that is very many pairs to look at, a round takes a share
    of these outsiders and then retires them, as all their pairs are settled; the last round takes all.
    """
    turn = 0
    while True:
        named = large.withColumn("component", F.lit(None).cast("long")) if comps is None else large.join(comps.withColumnRenamed("node", "id"), "id", "left")
        members = cut(named.select("key", "id", "n", "most", F.coalesce("component", "id").alias("component")))
        parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
        sums = parts.agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("members"), F.max("c").alias("main_members"))
        mixed = cut(sums.filter("main_members < members").select("key", "main", "members", "main_members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
        keys, cost = mixed.agg(F.count(F.lit(1)), F.sum(F.col("members") * (F.col("members") - F.col("main_members")))).first()
        if not keys:
            return comps if left is None else _settled(comps, left, texts)[0]
        open_ = members.join(small_table(mixed, keys), "key")
        share = PAIRS_A_ROUND / cost
        drawn = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1_000_000)) < share * 1_000_000
        outside = cut(open_.filter((F.col("component") != F.col("main")) & drawn).select("key", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("most").alias("x_most"), F.col("component").alias("other"), "blocks"))
        # a list's members are dealt over blocks, and each outsider meets every block
        each = outside.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")
        fits = (F.col("component") != F.col("other")) & (F.col("n") <= F.col("x_most")) & (F.col("xn") <= F.col("most"))
        pairs = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(each, ["key", "block"]).filter(fits).select(*_ends(F.col("id"), F.col("x"))).distinct()
        pairs = cut(pairs)
        if lists is not None:
            pairs = cut(_promising(pairs, pairs.count(), lists))
        comps, left = _settled(comps, cut(pairs if left is None else pairs.unionByName(left).distinct()), texts)
        if share >= 1:
            return comps
        done = outside.select("key", F.col("x").alias("id"))
        large = members.join(small_table(done, done.count()), ["key", "id"], "left_anti").drop("component")
        turn += 1


def similar_components(docs: DataFrame, mark: Callable[[bytes | None], int], marked_pairs: Callable[[DataFrame], DataFrame], bucket: int = BUCKET, max_ranked: int = MAX_RANKED) -> DataFrame:
    """node, component (its smallest id) over the links between the texts of ``docs`` (id bigint, text binary).

    Rows with a null id take no part; a text without links may be missing. Texts with one set of shingles are
    one to begin with; null and blank texts have an empty set. Of different texts with one id all list
    their shingles, and the least is compared. ``marked_pairs`` makes further candidates u, v from id, first_id
    (smallest id of the same set) and a text's ``mark``; they are checked like all others.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, mark, marked_pairs, bucket, max_ranked)


def _components(docs: DataFrame, mark: Callable[[bytes | None], int], marked_pairs: Callable[[DataFrame], DataFrame], bucket: int, max_ranked: int) -> DataFrame:
    usable = docs.filter("id is not null")
    ranks, all_ranked = ranking(usable, bucket, max_ranked)
    lists = cut(_lists(usable, ranks, mark))
    rows = lists.count()
    few = lambda df: fewer_tasks(df, rows, ROWS_PER_TASK)
    named = cut(few(few(lists).groupBy("k1", "k2").agg(F.min("id").alias("first_id"))))
    sure = few(few(lists.select("id", "k1", "k2")).join(named, ["k1", "k2"]).filter("id <> first_id")).select(F.col("id").alias("u"), F.col("first_id").alias("v"))
    own = lists.join(named.withColumnRenamed("first_id", "id"), ["id", "k1", "k2"], "left_semi")
    repeated = not few(lists.select("id")).groupBy("id").count().filter("count > 1").isEmpty()
    if repeated:
        own = own.dropDuplicates(["id", "k1", "k2"])
    sizes = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("ranked")).alias("sizes")
    rows_of = own.select("id", sizes, F.inline(F.arrays_zip("keys", "most")).alias("key", "most")).select("key", "id", "sizes", "most")
    # ranked shingles are only passed through, so their rows are dealt over all tasks
    spread = F.when(F.col("most") < 0, F.pmod(F.xxhash64("id"), F.lit(1024))).otherwise(F.lit(0))
    dealt = rows_of.repartition(F.col("key"), spread).sortWithinPartitions("key")
    met = cut(_met(dealt, bucket))
    large = met.filter("u is null").select("key", "id", "n", "most")
    firsts = cut(large.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "n", "most")).alias("first")).filter("members > 1"))
    n_large = firsts.count()
    large = cut(large.join(small_table(firsts, n_large), "key").select("key", "id", "n", "most", "first"))
    fits = (F.col("n") <= F.col("first")["most"]) & (F.col("first")["n"] <= F.col("most")) & (F.col("id") != F.col("first")["id"])
    pairs = met.filter("u is not null").groupBy("u", "v").agg(F.sum("share").alias("share"), F.min("need").alias("need"), F.bool_or("fits").alias("fits"))
    # where a list is large though its shingle isn't ranked, what its members share is not counted
    pairs = pairs.filter(F.col("fits") & (F.col("share") >= F.col("need"))) if all_ranked else pairs.filter("fits")
    unsure = pairs.select("u", "v").unionByName(large.filter(fits).select(*_ends(F.col("id"), F.col("first")["id"])))
    marked = few(few(lists.select("id", "mark", "k1", "k2")).join(named, ["k1", "k2"])).select("id", "first_id", "mark")
    unsure = cut(few(unsure.unionByName(marked_pairs(marked).filter("u <> v").select(*_ends(F.col("u"), F.col("v"))))).distinct())
    large = large.drop("first")
    ids = cut(few(unsure.select(F.explode(F.array("u", "v")).alias("id")).unionByName(large.select("id"))).distinct())
    n = ids.count()
    comps = None
    if n:
        texts = cut(usable.join(small(ids, n), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
        comps = _grown(*_settled(None, unsure, texts, once=True), large, texts, None if repeated else own)
    if comps is None:
        comps = docs.sparkSession.createDataFrame([], "node long, component long")
    if repeated:  # an id may stand for several sets
        return star_components(sure.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    firsts = comps.withColumnRenamed("node", "v")
    return few(sure).join(firsts, "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component")).unionByName(comps)
