"""Next-event lookups that never sort a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_event(
    left: DataFrame, events: DataFrame, keys: list[str], order: str, out: str, bucket: int
) -> DataFrame:
    """Add ``out``: the smallest ``events.order`` of the key that is greater than ``left.order``.

    ``order`` is a bigint. Rows are cut into buckets of ``bucket`` units; the
    answer is either inside the row's bucket or the head of the next bucket
    that has events, so the key-wide window sees one row per bucket only.
    """
    at = F.floor(F.col(order) / F.lit(bucket)).cast("bigint")
    cols = left.columns
    rows = left.select(F.struct(*cols).alias("__row"), *keys, F.col(order).alias("__o"), at.alias("__b"))
    marks = events.select(
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), *keys, F.col(order).alias("__o"), at.alias("__b")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__o").rangeBetween(1, Window.unboundedFollowing)
    local = (
        rows.unionByName(marks)
        .withColumn("__in", F.min(F.when(F.col("__row").isNull(), F.col("__o"))).over(inside))
        .filter(F.col("__row").isNotNull())
    )
    heads = marks.groupBy(*keys, "__b").agg(F.min("__o").alias("__head"))
    later = Window.partitionBy(*keys).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    buckets = (
        rows.select(*keys, "__b")
        .distinct()
        .join(heads, [*keys, "__b"], "full")
        .withColumn("__later", F.min("__head").over(later))
        .select(*keys, "__b", "__later")
    )
    return local.join(buckets, [*keys, "__b"], "left").select(
        "__row.*", F.coalesce("__in", "__later").alias(out)
    )


def last_before(
    left: DataFrame, events: DataFrame, keys: list[str], order: str, payload: str, out: str, bucket: int
) -> DataFrame:
    """Add ``out``: ``payload`` of the key's last event with a smaller ``order``; null when there is none.

    Bucketed like ``next_event``.
    """
    at = F.floor(F.col(order) / F.lit(bucket)).cast("bigint")
    cols = left.columns
    rows = left.select(F.struct(*cols).alias("__row"), *keys, F.col(order).alias("__o"), at.alias("__b"))
    marks = events.select(
        *keys, F.col(order).alias("__o"), at.alias("__b"), F.struct(F.col(order).alias("o"), F.col(payload).alias("p")).alias("__e")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__o").rangeBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("__e", F.lit(None).cast(marks.schema["__e"].dataType)).unionByName(
        marks.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType))
    )
    local = both.withColumn("__in", F.max("__e").over(inside)).filter(F.col("__row").isNotNull())
    tails = marks.groupBy(*keys, "__b").agg(F.max("__e").alias("__tail"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.select(*keys, "__b")
        .distinct()
        .join(tails, [*keys, "__b"], "full")
        .withColumn("__earlier", F.max("__tail").over(earlier))
        .select(*keys, "__b", "__earlier")
    )
    return local.join(buckets, [*keys, "__b"], "left").select(
        "__row.*", F.coalesce("__in.p", "__earlier.p").alias(out)
    )
