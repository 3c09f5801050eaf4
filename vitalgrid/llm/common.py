"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that where every character is one byte, and is much faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, per_part: int) -> int:
    """Number of groups so that one holds about ``per_part`` rows; grows with the data."""
    return max(1, -(-rows // per_part))


FEW_IDS = 2_000_000


def rows_of_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows that may be among ``ids`` (one column of that name), before a join that shuffles them.

    Up to ``FEW_IDS`` distinct ids (a few dozen MB) go to every task and the
    others' rows never leave theirs; beyond that all rows are passed on. The join
    behind gives the same result either way.
    """
    ids = ids.select(column).distinct()
    if ids.limit(FEW_IDS + 1).count() > FEW_IDS:
        return rows
    return rows.join(F.broadcast(ids), column, "left_semi")
