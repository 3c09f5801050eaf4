"""Aggregates that stay balanced when one key holds most rows; skewed joins are split at run time (``session.RUNTIME_CONF``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def first_by(df: DataFrame, keys: list[str], order: list, prefix: str = "") -> DataFrame:
    """First row per key in the given order as an aggregate, so hot keys are combined map-side.

    ``order`` holds columns that sort ascending and tell rows of one key apart.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last row per key, as ``first_by``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)
