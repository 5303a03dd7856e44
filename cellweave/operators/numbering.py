"""Dense numbers in the order of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.plans.lineage import cut

#: Rows that one task numbers.
ROWS_A_TASK = 200_000


def dense_numbers(rows: DataFrame, by: str, name: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` with ``name`` (INT): 0 and on in the order of ``by``, whose values differ.

    Up to ``rows_a_task`` rows are numbered in one task. More are cut into ranges of ``by``; a range is
    numbered by itself, from where the counts of the ranges before it end (a row for each range is collected).
    """
    rows = cut(rows)
    n = rows.count()
    if n <= rows_a_task:
        return rows.select("*", (F.row_number().over(Window.orderBy(by)) - 1).cast("int").alias(name))
    part = "__part"
    while part in rows.columns:
        part += "_"
    ranged = cut(rows.repartitionByRange(-(-n // rows_a_task), by).withColumn(part, F.spark_partition_id()))
    offset, offsets = 0, []
    for p, count in sorted(ranged.groupBy(part).count().collect()):
        offsets += [F.lit(p), F.lit(offset)]
        offset += count
    number = F.row_number().over(Window.partitionBy(part).orderBy(by)) - 1 + F.create_map(*offsets)[F.col(part)]
    return ranged.select("*", number.cast("int").alias(name)).drop(part)
