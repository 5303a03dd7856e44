"""Point sets from arrays, pandas frames and columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.params import Params


def from_numpy(spark: SparkSession, X: np.ndarray) -> DataFrame:
    """id (the row's position), x, y from an (N, 2) array; 32-bit floats stay such through Arrow."""
    X = np.ascontiguousarray(X)
    kind = pa.float32() if X.dtype == np.float32 else pa.float64()
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(X)), pa.int64()), "x": pa.array(X[:, 0], kind), "y": pa.array(X[:, 1], kind)}))


def check_array(X: np.ndarray, params: Params) -> None:
    """The tests that ``grid.check_points`` makes of a table's coordinates."""
    if bad := int((~np.isfinite(X).all(axis=1)).sum()):
        raise ValueError(f"{bad} points have null or non-finite coordinates")
    if len(X) and np.abs(np.floor(X * np.float32(params.inv_r)).astype(float)).max() >= (1 << 31) - 2:
        raise ValueError("coordinates are too large for cells of this eps")


def from_pandas(spark: SparkSession, frame: pd.DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return from_numpy(spark, frame[[x, y]].to_numpy(dtype=np.float32))


def from_array_column(df: DataFrame, id: str, column: str) -> DataFrame:
    """id, x, y from the first two elements of an array column."""
    return df.select(F.col(id).cast("long").alias("id"), F.get(column, F.lit(0)).cast("float").alias("x"), F.get(column, F.lit(1)).cast("float").alias("y"))
