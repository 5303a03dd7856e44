"""Vector codes: each part of a vector is named by its nearest entry of a small codebook, in whole numbers.

Components become integers, so sums, distances and codebooks are the same however the rows are dealt. Codebooks
are fitted by rounds of assignment and averaging: a round is one pass over the vectors, of which each task sends
sums of a fixed number of slots. The nearest entry is found by partial distances: dimensions are processed in
descending variance of the codebook, and a mask drops an entry as soon as its accumulated distance strictly exceeds
the best complete distance known for the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans.lineage import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows whose distances are worked out at a time.
BLOCK = 4096
#: Labels (a sum of 8 bytes each) that may be broadcast.
BROADCAST_LABELS = 200_000


def finite_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """vec_id, embedding (doubles) and, if asked for, label of the rows whose vector is there and finite throughout."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = [F.col(label_col).alias("label")] if label_col else []
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), *label)
    return rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", bad))


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of the entries ``book`` (k, width) to each row of ``x``, ties to the lower index.

    Each row starts with the complete distance to one likely entry. Rows and entries then meet dimension by
    dimension, those of the largest variance over the codebook first; entries beyond the row's best are dropped on the way.
    """
    k = len(book)
    order = np.argsort(-book.var(axis=0), kind="stable")
    likely = np.abs(x[:, order[0], None] - book[None, :, order[0]]).argmin(axis=1)
    best = ((x - book[likely]) ** 2).sum(axis=1)
    row, entry = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
    far = np.zeros(len(row), np.int64)
    for d in order:
        far += (x[row, d] - book[entry, d]) ** 2
        alive = far <= best[row]
        row, entry, far = row[alive], entry[alive], far[alive]
    # of what is left of a row, which is its likely entry at least, distance first and then index
    found = np.minimum.reduceat(far * k + entry, np.flatnonzero(np.diff(row, prepend=-1))) if len(row) else far
    return found % k, found // k


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (parts, entries, components of a part) whole numbers; vectors are multiplied by ``scale`` and floored."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dimensions(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def parts_of(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, parts, width) whole numbers of (rows, dimensions) doubles."""
        whole = np.floor(vectors * self.scale)
        # four times the square, over a part, with an index below it, stays within 63 bits
        limit = 2 ** ((59 - (self.entries.shape[2] * self.entries.shape[1] - 1).bit_length()) // 2)
        if len(whole) and max(-whole.min(), whole.max()) >= limit:
            raise ValueError(f"components must be below {limit // self.scale} in size to be compared in 64 bits")
        return whole.astype(np.int64).reshape(len(vectors), self.entries.shape[0], -1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) indexes and squared distances."""
        found = [nearest_entries(x[:, p], self.entries[p]) for p in range(x.shape[1])]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
        yield b, b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _averaged(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all ``rows``: one pass; a task sends a fixed number of sums."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for _, v in _blocks(batches, books.dimensions):
            x = books.parts_of(v)
            code, _ = books.assign(x)
            for p in range(parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p])
                total[p, :, width] += np.bincount(code[:, p], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["slot", "value"])

    sums = np.zeros(parts * k * (width + 1), np.int64)
    for slot, value in rows.select("embedding").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value")).collect():  # parts * k * (width + 1) rows
        sums[slot] = value
    sums = sums.reshape(parts, k, width + 1)
    count = sums[:, :, width:]
    return Codebooks(np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books.entries), books.scale)


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``rows`` (``finite_vectors``); None if no row's length is a positive multiple of ``parts``.

    They start as the parts of the vectors of the smallest ids (null ids last, equal ids by their vectors); with fewer
    vectors there are fewer entries. Every round is over all rows; an entry that no part takes stays.
    """
    fit = rows.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    by = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = fit.orderBy(*by).select("embedding").first()
    if first is None:
        return None
    seeds = np.array([r[0] for r in fit.filter(F.size("embedding") == len(first[0])).orderBy(*by).select("embedding").limit(entries).collect()], float)
    shape = (parts, len(seeds), len(first[0]) // parts)
    books = Codebooks(np.zeros(shape, np.int64), scale)
    books = Codebooks(books.parts_of(seeds).transpose(1, 0, 2), scale)
    rows = fit.filter(F.size("embedding") == books.dimensions)
    for _ in range(rounds):
        books = _averaged(rows, books)
    return books


def encode_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label (where ``rows`` have it), code (two hex digits for each part) and error of ``finite_vectors`` of the codebooks' length."""
    kept = [c for c in ("vec_id", "label") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in _blocks(batches, books.dimensions):
            code, far = books.assign(books.parts_of(v))
            text = pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], text, pa.array(far.sum(axis=1))], [*kept, "code", "error"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.filter(F.size("embedding") == books.dimensions).select(*kept, "embedding").mapInArrow(run, f"{schema}, code string, error long")


def decode_vectors(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` (with code) and the vector ``decoded`` that each code stands for, the middles of its entries' steps."""
    parts, _, width = books.entries.shape
    table = F.lit(((books.entries + 0.5) / books.scale).ravel().tolist())
    k = books.entries.shape[1]
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("decoded", F.concat(*[F.slice(table, (index(p) + p * k) * width + 1, F.lit(width)) for p in range(parts)]))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels added up, nulls together), codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped; so are vectors whose length is no
    multiple of eight, or another than that of the first vector left (by id, null ids last). Zero vectors and
    repeated rows stay, each a row. Equal distances go to the lower index. An empty table gives no rows. Components of
    size 2**14 and more are refused. Other columns don't matter.
    """
    rows = finite_vectors(vectors, id_col, vector_col, label_col)
    books = fit_codebooks(rows)
    if books is None:
        ids = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {ids}, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode_vectors(rows, books))
    sums = cut(coded.groupBy(F.col("label").alias("__of")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
