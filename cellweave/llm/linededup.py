"""Line de-duplication over overlapping three-line windows.

Every three consecutive lines are a window, hashed to 128 bits. A window that occurs again (in the order
of doc_id, text hash and position) is a later occurrence; the positions that later occurrences cover are
merged and removed. Each removed line has an earlier equal line, so the first copy of any line remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import let, unused
from cellweave.plans.lineage import cut

WINDOW = 3
#: Positions of repeated windows (4 bytes each) that a task holds while texts stream past.
HASHED_POSITIONS = 8_000_000


def _windows(lines: Column) -> Column:
    """array<struct<pos, h1, h2>>, without windows whose lines are all blank."""

    def at(i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(WINDOW)]
        blank = F.trim(parts[0]) == ""
        for p in parts[1:]:
            blank = blank & (F.trim(p) == "")
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("w"), *parts).alias("h2")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), at), lambda w: w.isNotNull())
    return F.when(F.size(lines) >= WINDOW, found)


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, starts: the sorted positions of each document's later occurrences."""
    windows = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.inline(let(F.split(F.col(text_col), "\n"), _windows)),
    )
    place = F.struct("doc_id", "text_hash", "pos")
    # counted and minimised before the shuffle, so that a window in a third of the texts is a row for each task
    repeated = cut(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"))
    later = windows.join(repeated, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _without(lines: Column, starts: Column) -> Column:
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: s + k))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    return F.transform(kept, lambda p: F.get(lines, p))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with the text's repeated lines removed, all columns kept; counts under the given names.

    A row is known by its id and text: repeated rows count as one document and are treated alike; rows
    with one id and different texts are ordered by the text's hash; null ids come first. Texts of fewer
    than three lines have no window and stay. Null and empty texts stay as they are (a null one has no
    lines). A text may become empty, when all its lines occur before it. An empty table stays empty.
    """
    key, digest, starts = (unused(docs, x) for x in ("__id", "__digest", "__starts"))
    later = cut(later_windows(docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("starts").alias(starts)))
    held, largest = later.agg(F.coalesce(F.sum(F.size(starts)), F.lit(0)) + 16 * F.count(F.lit(1)), F.coalesce(F.max(F.size(starts)), F.lit(0))).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = held / tasks + largest <= HASHED_POSITIONS  # otherwise the join sorts, and may spill
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(digest))
    joined = docs.join(later.hint("shuffle_hash") if few else later, same, "left")
    lines = F.split(F.col(text_col), "\n")
    made = F.when(F.col(starts).isNull(), F.struct(F.col(text_col).alias("text"), F.lit(0).alias("gone"))).otherwise(
        let(lines, lambda x: let(_without(x, F.col(starts)), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(x) - F.size(kept)).alias("gone"))))
    )
    out = unused(docs, "__made")
    counted = [F.coalesce(F.size(lines), F.lit(0)).alias(n_lines)] if n_lines else []
    counted += [F.col(out)["gone"].alias(n_removed)] if n_removed else []
    columns = [F.col(out)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.withColumn(out, made).select(*columns, *counted)
