"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint holds, for each of 64 bits, the majority over a text's word shingles. Two fingerprints
link when at most two bits differ. The 64 bits are a ring of five segments. By the pigeonring
principle a linked pair has a start segment from which every chain of consecutive segments keeps to
its share of the two differences: 0, 0, 1, 1, 2. So from that start the first two segments are equal
and at least one of the next two is: ten (start, third segment) keys of 38 or 39 bits find every pair.
A candidate's chain is checked segment by segment before the full Hamming distance.

A key shared by more than ``bucket`` different fingerprints is never expanded into pairs. Its
fingerprints are put, each with all of its one-bit neighbours, into balls of radius one: two
fingerprints share a ball's centre exactly if they differ in two bits or fewer, and a ball has 65
members at most, so linking each to the ball's smallest keeps all connections with 65 rows for each.

Two bits of one fingerprint reach few texts with changed words: at a similarity of 0.8 of the five-word
shingles, about 10 of 64 bits differ, and for so many the segments of a ring are too short to tell texts
apart. So groups may be completed (``similar``): the links are candidates then, the rest of the candidates come
from an exact join of the shingle sets, and every one is checked by the whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import per_text, small_batches, unused
from cellweave.llm.similar import shingles, similar_components, small, words
from cellweave.operators.components import star_components
from cellweave.plans.lineage import cut, fewer_tasks

WIDTHS = (13, 13, 13, 13, 12)
#: Differences allowed over a chain of 1 to 5 consecutive segments: floor(length * 2 / 5).
BUDGETS = (0, 0, 1, 1, 2)
#: Keys shared by more different fingerprints than this are linked through balls.
BUCKET = 24
#: Fingerprints (16 bytes each, ten keys) that one task handles.
ROWS_PER_TASK = 25_000

_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype=np.uint64)


#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; 0 for null, empty or blank texts."""
    import xxhash

    parts = shingles(words(text), SHINGLE)
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    lanes = _SPREAD[np.frombuffer(b"".join([digest(x, SEED) for x in parts]), np.uint8).reshape(-1, 8)]
    n = len(lanes)
    # 255 rows at a time fit the byte-wide counters that the table spreads bits into
    counts = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * counts > n)[:, ::-1]).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments() -> list[int]:
    masks, at = [], 64
    for w in WIDTHS:
        at -= w
        masks.append(((1 << w) - 1) << at)
    return masks


def _keys(fp: Column) -> Column:
    seg, m = _segments(), len(WIDTHS)
    rows = []
    for start in range(m):
        for third in (2, 3):
            mask = seg[start] | seg[(start + 1) % m] | seg[(start + third) % m]
            rows.append(F.struct(F.lit(2 * start + third - 2).alias("chain"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key")))
    return F.array(*rows)


def _chain_holds(difference: Column, chain: Column) -> Column:
    """Whether every chain from the key's start keeps its budget; the last of them is the Hamming check."""
    seg, m = _segments(), len(WIDTHS)
    checks = []
    for length in range(3, m + 1):
        masks = [_signed(sum(seg[(start + i) % m] for i in range(length))) for start in range(m) for _ in (2, 3)]
        mask = F.element_at(F.array(*[F.lit(x) for x in masks]), chain + 1)
        checks.append(F.bit_count(difference.bitwiseAND(mask)) <= BUDGETS[length - 1])
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def fingerprint_links(prints: DataFrame, rows: int, bucket: int = BUCKET) -> DataFrame:
    """Links u < v between different fingerprints (column fp, distinct, ``rows`` at most) that keep all connections.

    Every pair within two bits is connected by the links, and every link is such a pair.
    """
    at = ["chain", "key"]
    few = lambda df: fewer_tasks(df, rows, ROWS_PER_TASK)
    keys = few(prints).select("fp", F.inline(_keys(F.col("fp"))))
    sizes = cut(few(keys.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")))
    shared = few(keys.join(sizes, at))
    groups = shared.filter(F.col("n") <= bucket).groupBy(*at).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda x, i: F.transform(
                F.filter(F.slice("fps", i + 2, F.size("fps")), lambda y: _chain_holds(x.bitwiseXOR(y), F.col("chain"))),
                lambda y: F.struct(x.alias("u"), y.alias("v")),
            ),
        )
    )
    near = few(groups.select(F.inline(pairs)))
    if sizes.filter(F.col("n") > bucket).isEmpty():
        return near.distinct()
    hot = few(shared.filter(F.col("n") > bucket).select("fp").distinct())
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]
    balls = hot.select("fp", F.explode(F.array(*flips)).alias("centre")).groupBy("centre").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = balls.select(F.inline(F.transform(F.slice("fps", 2, 65), lambda y: F.struct(F.col("fps")[0].alias("u"), y.alias("v")))))
    return near.unionByName(few(stars)).distinct()


def _classes(prints: DataFrame, rows: int) -> DataFrame:
    """fp, first_id: the smallest id of each different fingerprint."""
    one = fewer_tasks(prints, rows, ROWS_PER_TASK).groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    return cut(fewer_tasks(one, rows, ROWS_PER_TASK))


def _prints(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id and fp of every row, and the number of rows."""
    of = lambda texts: [_signed(fingerprint(t)) for t in texts]
    with small_batches(docs.sparkSession):
        prints = cut(per_text(docs, id_col, text_col, "bigint", of).withColumnRenamed("value", "fp"))
    return prints, prints.count()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in two bits or fewer. A group is what links connect, named by
    its smallest id. Null and blank texts have fingerprint zero and link like any other. Repeated rows stay. A
    null id takes part but never names a group, unless the group has no other (then component_id is null). An
    empty table gives an empty result. Only the id and text are read; other columns don't matter.
    """
    prints, rows = _prints(docs, id_col, text_col)
    few = lambda df: fewer_tasks(df, rows, ROWS_PER_TASK)
    classes = _classes(prints, rows)
    comps = star_components(fingerprint_links(classes.select("fp"), rows, bucket))
    linked = few(classes.join(few(comps).withColumnRenamed("node", "fp"), "fp", "left")).select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = few(linked.groupBy("root").agg(F.min("first_id").alias("component_id")))
    # materialised, so that a fingerprint with a third of the rows is a skewed join that can be split
    members = cut(few(linked.join(smallest, "root").select("fp", "component_id")))
    shown = few(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp")
    return shown.join(members, "fp", "left").select("doc_id", "fingerprint", "component_id")


def _similar(docs: DataFrame, id_col: str, text_col: str, bucket: int) -> DataFrame:
    """node, component of the documents that are 0.8 similar; those without links may be missing."""

    def pairs(marked: DataFrame) -> DataFrame:
        """Between first documents of linked fingerprints, and between those of one fingerprint and different texts."""
        one = marked.groupBy("mark").agg(F.min("first_id").alias("at"), F.count(F.lit(1)).alias("n"))
        classes = cut(one)
        rows = classes.count()
        few = lambda df: fewer_tasks(df, rows, ROWS_PER_TASK)
        links = fingerprint_links(classes.select(F.col("mark").alias("fp")), rows, bucket)
        of = lambda x, y: few(classes).select(F.col("mark").alias(x), F.col("at").alias(y))
        between = few(few(links).join(of("u", "a"), "u")).join(of("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        within = marked.join(few(classes).filter("n > 1"), "mark").filter("first_id <> at").select(F.col("first_id").alias("u"), F.col("at").alias("v"))
        return between.unionByName(within.distinct())

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return similar_components(texts, lambda t: _signed(fingerprint(t)), pairs, bucket)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, component_id of every row with an id: groups of texts that are 0.8 similar.

    Documents link if their five-word shingles (white space apart, A-Z in lower case) have a Jaccard similarity of
    0.8 or more; links of fingerprints are candidates like others. A group is what links connect, named by its
    smallest id. Null and blank texts are similar to each other. Repeated rows stay; of different texts with one
    id the least is compared. Rows with a null id are left out. An empty table gives an empty result.
    """
    comps = cut(_similar(docs, id_col, text_col, bucket))
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null")
    return ids.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The documents that name their group (smallest id) of ``similar_groups``; of rows that repeat id and text, one.

    Different texts of one id stay or go together. A row with a null id cannot name a group and is kept as it is.
    """
    gone_id = unused(docs, "__gone")
    gone = cut(_similar(docs, id_col, text_col, bucket).filter("node <> component").select(F.col("node").alias(gone_id)).distinct())
    kept = docs.join(small(gone, gone.count()), F.col(id_col) == F.col(gone_id), "left_anti")
    if docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty():
        return kept
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(kept.filter(F.col(id_col).isNull()))
