"""Small column helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts that a worker holds at a time.
TEXTS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXTS) -> Iterator[None]:
    """Jobs that run inside send no more than so many rows to a worker at once: texts are long, and a batch of the
    usual 10,000 is held by the executor and by its worker. The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_array(values: Sequence, kind: str) -> Column:
    """A constant array, sent as one string and folded to a literal before the query runs."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def last_not_above(keys: Sequence[Column], bounds: Sequence[Column], n: int) -> Column:
    """How many of ``n`` sorted bounds (parallel constant arrays) are at most ``keys``: a binary search."""
    steps = [1 << i for i in reversed(range(max(n, 1).bit_length()))]

    def reach(at: Column, step: Column) -> Column:
        bound = F.struct(*[F.get(b, at + step - 1) for b in bounds])
        return F.when((at + step <= n) & (bound <= F.struct(*keys)), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), reach)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each value what ``merge`` makes of it and all before it. Blocks keep the cost near linear: a growing
    array in an aggregate would be copied at every step."""
    n = F.size(values)
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0)))

    def spread(totals: Column) -> Column:
        def inside(b: Column) -> Column:
            before = F.aggregate(F.slice(totals, F.lit(1), b), zero, merge)
            part = F.slice(values, b * block + 1, F.lit(block))
            return let(F.struct(before.alias("before"), part.alias("part")), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["part"])), lambda i: F.aggregate(F.slice(x["part"], F.lit(1), i), x["before"], merge)))

        return F.flatten(F.transform(blocks, inside))

    totals = F.transform(blocks, lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), zero, merge))
    return F.when(n > 0, let(totals, spread)).otherwise(F.slice(values, 1, 0))


def per_text(docs: DataFrame, id_col: str, text_col: str, kind: str, of: Callable[[list[bytes | None]], list]) -> DataFrame:
    """doc_id and ``value`` (of Spark type ``kind``): ``of`` a batch's whole texts, as UTF-8, one value each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, TEXTS) for x in batches for at in range(0, x.num_rows, TEXTS)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(of(b.column("text").to_pylist()), arrow)], ["doc_id", "value"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, value {kind}")
