"""Points in intervals as equi joins: a dyadic index over time.

Time is cut into cells of 2**36 microseconds (19 hours). An interval's cells
are covered by blocks of 1, 2, 4, ... cells, each aligned to its size: at most
two of a size, so a span of n cells takes 2 log n rows whatever its length, and
an open end costs no more. A point lies in one block of each size and in one
block of an interval at most, so a join on (keys, size, block) finds every pair
once, and no key gathers all intervals or all points of a long history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import cut_lineage

CELL_BITS = 36
#: Cells from 1684 to 2255; times beyond fall into the first or last one, and the exact comparison parts them.
LEVELS = 18


def cell(time: Column) -> Column:
    at = F.shiftright(F.unix_micros(time) + F.lit(2**53), CELL_BITS)
    return F.least(F.greatest(at, F.lit(0)), F.lit(2**LEVELS - 1)).cast("bigint")


def _blocks(first: str, last: str) -> Column:
    """Array of (level, block) that cover the cells ``first`` to ``last``."""
    low, high = f"shiftright({first} + shiftleft(1L, l) - 1, l)", f"shiftright({last} + 1, l)"
    return F.expr(
        f"""filter(flatten(transform(sequence(0, {LEVELS}), l -> array(
          if({low} < {high} and {low} % 2 = 1, named_struct('level', l, 'block', {low}), null),
          if({low} < {high} and {high} % 2 = 1, named_struct('level', l, 'block', {high} - 1), null)))), x -> x is not null)"""
    )


def in_force(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str) -> DataFrame:
    """Points joined with the intervals of their keys that hold at ``time``: ``start`` <= time < ``end``, null end = open.

    Columns of both sides but for ``start`` and ``end``. Empty intervals and a
    null time, start or key join with nothing; repeated rows join one by one.
    """
    last = F.when(F.col(end).isNull(), F.lit(2**LEVELS - 1)).otherwise(cell(F.col(end) - F.expr("interval 1 microsecond")))
    covered = (
        intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
        .withColumn("__first", cell(F.col(start))).withColumn("__last", last)
        .withColumn("__b", F.explode(_blocks("__first", "__last")))
        .select(*[c for c in intervals.columns], F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    )
    indexed = cut_lineage(covered)
    # Points probe the sizes that occur for their keys only; those without an interval stay out of the join.
    sizes = indexed.groupBy(*keys).agg(F.collect_set("__level").alias("__levels"))
    probes = (
        points.join(sizes, keys)
        .withColumn("__cell", cell(F.col(time)))
        .withColumn("__level", F.explode("__levels"))
        .withColumn("__block", F.expr("shiftright(__cell, __level)"))
        .drop("__levels", "__cell")
    )
    return (
        probes.join(indexed, [*keys, "__level", "__block"])
        .filter((F.col(start) <= F.col(time)) & (F.col(end).isNull() | (F.col(time) < F.col(end))))
        .drop("__level", "__block", start, end)
    )
