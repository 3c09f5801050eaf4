"""Number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_decimals(x: Column) -> Column:
    """``%.2f`` that rounds the exact binary value, as C and Go print it.

    ``format_string`` rounds the shortest decimal text half up. Both agree
    unless that text ends in a 5 at the third decimal, so only such values are
    decided by comparing the exact fraction, scaled to an integer, with the tie.
    From 2**63 on the digits are those of the shortest decimal text.
    """
    size = F.least(F.abs(x), F.lit(2.0**53))  # from there on no value has a fraction
    whole = F.floor(size)
    part = size - whole  # exact
    thousandths = F.round(part * 1000).cast("bigint")
    is_tie = (F.pmod(thousandths, F.lit(10)) == 5) & (size == whole + thousandths / F.lit(1000.0))
    fraction = (part * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)")
    tie = thousandths.cast("decimal(20,0)") * F.lit(2**60).cast("decimal(20,0)")
    scaled = fraction * F.lit(1000).cast("decimal(5,0)")
    below = F.floor((thousandths - 5) / F.lit(10))
    even = F.pmod(below, F.lit(2)) == 0
    hundredths = F.when(scaled < tie, below).when(scaled > tie, below + 1).otherwise(F.when(even, below).otherwise(below + 1))
    exact = F.format_string(
        "%s%d.%02d",
        F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
        whole + F.floor(hundredths / 100),
        F.pmod(hundredths, F.lit(100)),
    )
    whole_number = F.when(F.abs(x) >= 2.0**53, x.try_cast("bigint"))  # null from 2**63 on
    return (
        F.when(is_tie, exact)
        .when(whole_number.isNotNull(), F.format_string("%d.00", whole_number))
        .otherwise(F.format_string("%.2f", x))
    )
