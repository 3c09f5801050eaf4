"""Time zones."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def known_zones() -> list[str]:
    """The zone names Spark's own runtime knows, about 600: a bounded literal list, tested as a hash set."""
    java = SparkSession.active().sparkContext._jvm.java
    return sorted(java.lang.String.join("\n", java.time.ZoneId.getAvailableZoneIds()).split("\n"))


def known_zone(zone: Column) -> Column:
    """The zone, or null when it is null or unknown (Spark fails on unknown zones)."""
    return F.when(zone.isin(known_zones()), zone)


def zone_or_utc(zone: Column) -> Column:
    return F.coalesce(known_zone(zone), F.lit("UTC"))


def local_time(instant: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(instant, zone)


def local_date(instant: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))
