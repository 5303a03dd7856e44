"""Exact density-based clustering of 2-D points, declared as Spark DataFrame plans."""

from cellweave.plans.dbscan import DBSCAN, ArrayLike2D, dbscan2d

__all__ = ["ArrayLike2D", "DBSCAN", "dbscan2d"]
__version__ = "0.1.0"
