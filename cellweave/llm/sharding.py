"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

The key of a record is (hash of its text, hash of its id), so equal texts lie side by side. A bounded,
size-weighted sample of keys gives the boundaries of fine ranges, each small enough for one task; a key
that is too heavy for one range is cut within itself, because boundaries hold both parts of the key, and
ranges that turn out overfull are divided again. Exact sizes of the ranges then place every record on a
line of bytes, and the line is cut into shards of equal length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.exprs import last_not_above, number_array
from cellweave.plans.lineage import cut

#: Records a fine range should hold, and the most ranges (and so rows that the driver sees) there may be.
RANGE_RECORDS, MAX_RANGES, SAMPLES_PER_RANGE = 50_000, 8192, 24
#: Texts that occur more than once stay in one shard if they take at most this share of it.
WHOLE_GROUP = 0.01
_LOWEST = -(1 << 63)


def _boundaries(sample: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` - 1 weighted quantiles of key-sorted samples; a key with one cut is left whole."""
    if not len(sample):
        return sample
    reached = np.cumsum(weight)
    at = np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts)
    cuts = np.unique(sample[np.minimum(at, len(sample) - 1)])
    groups, counts = np.unique(cuts["g"], return_counts=True)
    single = np.isin(cuts["g"], groups[counts == 1])
    cuts["t"][single] = _LOWEST
    return np.unique(cuts)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole_group: float = WHOLE_GROUP) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard for every row of ``docs``.

    Shards hold nearly equal bytes: they differ by one text and ``whole_group`` of a shard at most. A null
    text has size 1 and the checksum of an empty text. Repeated rows and null ids are placed like
    others; an empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            F.xxhash64(F.col(id_col)).alias("t"),
        )
    )
    rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(MAX_RANGES, max(1, 8 * shards, rows // RANGE_RECORDS))
    wanted = parts * SAMPLES_PER_RANGE
    share = max(total / wanted, 1.0)
    # each record is drawn with probability size / share; heavier ones always, at their own weight
    drawn = (F.xxhash64("t", F.lit(11)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < F.col("size") / F.lit(share)
    table = keyed.filter(drawn).select("g", "t", F.greatest(F.col("size").cast("double"), F.lit(share)).alias("w")).toArrow()  # about ``wanted`` rows
    sample = np.zeros(table.num_rows, dtype=[("g", "<i8"), ("t", "<i8")])
    sample["g"], sample["t"] = table["g"].to_numpy(), table["t"].to_numpy()
    order = np.argsort(sample, order=("g", "t"))
    sample, weight = sample[order], table["w"].to_numpy()[order]
    cuts = _boundaries(sample, weight, parts)

    def ranged(cuts: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        bounds = [number_array(cuts[f].tolist(), "bigint") for f in ("g", "t")]
        placed = keyed.withColumn("range", last_not_above([F.col("g"), F.col("t")], bounds, len(cuts)))
        held = placed.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()  # a row for each range
        size, count = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for r, b, n in held:
            size[r], count[r] = b, n
        return placed, size, count

    placed, size, count = ranged(cuts)
    overfull = np.flatnonzero(size > 2 * max(total / parts, 1))
    if len(overfull):
        owner = np.searchsorted(cuts, sample, side="right") if len(cuts) else np.zeros(len(sample), int)
        finer = [cuts]
        for r in overfull:
            inside = owner == r
            finer.append(_boundaries(sample[inside], weight[inside], int(min(64, 1 + size[r] * parts // max(total, 1)))))
        more = np.unique(np.concatenate(finer))
        if len(more) > len(cuts):
            placed, size, count = ranged(more)

    before = lambda x: number_array((np.cumsum(x) - x).tolist(), "bigint")
    along = Window.partitionBy("range").orderBy("g", "t", "doc_id")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "g")
    line = placed.select(
        "*",
        (F.get(before(size), F.col("range")) + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("from_byte"),
        (F.get(before(count), F.col("range")) + F.row_number().over(along) - 1).alias("nth"),
    ).select("*", F.min("from_byte").over(group).alias("group_byte"), F.sum("size").over(group).alias("group_size"))
    position = F.when(F.col("group_size") <= F.lit(int(whole_group * total / shards)), F.col("group_byte")).otherwise(F.col("from_byte"))
    shard = F.least((position * shards / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1))
    sharded = cut(line.select("doc_id", "size", "text_crc32", shard.alias("shard"), "nth"))
    first = dict(sharded.groupBy("shard").agg(F.min("nth")).collect())  # a row for each shard
    starts = number_array([int(first.get(s, 0)) for s in range(shards)], "bigint")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
