"""Reading the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read one parquet table; zone-less timestamps become instants (the session zone is UTC)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return as_instants(reader.parquet(path))


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """The same table from a database, read in parallel slices of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: load_table(spark, f"{folder}/{name}.parquet") for name in names}


def as_instants(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
    )


def as_zoneless(df: DataFrame) -> DataFrame:
    """Instants back to zone-less UTC timestamps, the form the parquet tables use."""
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    )
