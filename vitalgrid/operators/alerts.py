"""Threshold alerts: from readings to one message per device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import two_decimals
from vitalgrid.functions.skew import last_by


def catalog_array(metric_types: DataFrame):
    """The metric catalog as one array value, computed once per query; only for the full user x metric grid."""
    entry = F.struct(
        F.col("id").alias("metric_id"), F.col("name").alias("metric_name"),
        "default_min_value", "default_max_value", "created_at",
    )
    return metric_types.agg(F.collect_list(entry)).scalar()


def effective_thresholds(users: DataFrame, metric_types: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every user x metric: own bounds, else the catalog's; enabled unless switched off."""
    grid = users.select(F.col("id").alias("user_id"), F.inline(catalog_array(metric_types)))
    return _merged(grid.join(thresholds, ["user_id", "metric_id"], "left"))


def _merged(joined: DataFrame) -> DataFrame:
    return joined.select(
        "user_id",
        "metric_id",
        "metric_name",
        F.coalesce("min_value", "default_min_value").alias("min_value"),
        F.coalesce("max_value", "default_max_value").alias("max_value"),
        F.coalesce("is_enabled", F.lit(True)).alias("is_enabled"),
        F.coalesce("updated_at", "created_at").alias("updated_at"),
    )


def thresholds_for(pairs: DataFrame, metric_types: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The same rule for the (user_id, metric_type) pairs asked for only."""
    catalog = metric_types.select(
        F.col("id").alias("metric_id"), F.col("name").alias("metric_name"),
        "default_min_value", "default_max_value", "created_at",
    )
    asked = pairs.select("user_id", F.col("metric_type").alias("metric_name")).distinct().join(catalog, "metric_name")
    return _merged(asked.join(thresholds, ["user_id", "metric_id"], "left"))


def threshold_breaches(readings: DataFrame, effective: DataFrame) -> DataFrame:
    """Readings outside enabled bounds; the lower bound is tested first, both strictly."""
    bounds = effective.filter(
        F.col("is_enabled") & (F.col("min_value").isNotNull() | F.col("max_value").isNotNull())
    ).select("user_id", F.col("metric_name").alias("metric_type"), "min_value", "max_value")
    low = F.col("value") < F.col("min_value")
    high = F.col("value") > F.col("max_value")
    return (
        readings.join(bounds, ["user_id", "metric_type"])
        .filter(low | high)
        .withColumn("level", F.when(low, F.lit("low")).otherwise(F.lit("high")))
        .withColumn("threshold", F.when(low, F.col("min_value")).otherwise(F.col("max_value")))
        .drop("min_value", "max_value")
    )


def alert_fanout(breaches: DataFrame, watchers: DataFrame, users: DataFrame) -> DataFrame:
    """One message to the owner and one per (watcher, group name).

    ``watchers`` is the result of ``metric_watchers``. An owner without a user
    row is called 'Unknown User'.
    """
    value = two_decimals(F.col("value"))
    bound = two_decimals(F.col("threshold"))
    passing = [c for c in breaches.columns if c not in ("user_id",)]
    data = [
        F.lit("metric_type"), F.col("metric_type"),
        F.lit("value"), value,
        F.lit("level"), F.col("level"),
    ]
    to_owner = breaches.select(
        F.col("user_id").alias("recipient_id"),
        F.col("user_id").alias("owner_id"),
        F.lit(None).cast("string").alias("group_name"),
        *passing,
        F.lit("Health Alert").alias("title"),
        F.format_string(
            "Health Alert: Your %s is %s (%s). Threshold is %s", "metric_type", "level", value, bound
        ).alias("body"),
        F.create_map(F.lit("type"), F.lit("health_alert"), *data).alias("data"),
    )
    names = users.select(F.col("id").alias("owner_id"), F.col("name").alias("found_name"), F.lit(True).alias("known"))
    named = watchers.join(names, "owner_id", "left").withColumn(
        "owner_name",
        F.when(F.col("known").isNull(), F.lit("Unknown User"))
        # a stored NULL name cannot be read there, and the alert goes out for "A user"
        .otherwise(F.coalesce("found_name", F.lit("A user"))),
    )
    to_watchers = (
        breaches.withColumnRenamed("user_id", "owner_id")
        .join(named.select("owner_id", "metric_type", "watcher_id", "group_name", "owner_name"), ["owner_id", "metric_type"])
        .select(
            F.col("watcher_id").alias("recipient_id"),
            "owner_id",
            "group_name",
            *passing,
            F.lit("Health Alert (Shared)").alias("title"),
            F.format_string(
                "Health Alert: %s's %s in group %s is %s (%s). Threshold is %s",
                "owner_name", "metric_type", "group_name", "level", value, bound,
            ).alias("body"),
            F.create_map(
                F.lit("type"), F.lit("health_alert_shared"), *data,
                F.lit("owner_id"), F.col("owner_id").cast("string"),
                F.lit("owner_name"), F.col("owner_name"),
                F.lit("group_name"), F.col("group_name"),
            ).alias("data"),
        )
    )
    return to_owner.unionByName(to_watchers)


def device_messages(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Message x device token of the recipient; recipients without a token get nothing."""
    return messages.join(tokens.select(F.col("user_id").alias("recipient_id"), "token"), "recipient_id")


def apply_thresholds(thresholds: DataFrame, changes: DataFrame, metric_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert by (user, metric): the last change wins; unknown metrics are refused.

    ``changes``: seq, user_id, metric_id, min_value, max_value, is_enabled, updated_at.
    Returns (table, refused changes).
    """
    known = metric_types.select(F.col("id").alias("metric_id"))
    valid = changes.join(known, "metric_id", "left_semi")
    refused = changes.join(known, "metric_id", "left_anti")
    rows = thresholds.withColumn("seq", F.lit(None).cast("bigint")).unionByName(valid.select(*thresholds.columns, "seq"))
    # nulls sort first in max_by's ordering of structs, so stored rows lose to any change
    table = last_by(rows, ["user_id", "metric_id"], [F.coalesce("seq", F.lit(-(2**63)))]).drop("seq")
    return table, refused


def apply_device_tokens(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """Save or delete by (user, token) in order of seq: the last change per token decides.

    ``changes``: seq, op ('save' or 'delete'), user_id, token, platform, updated_at.
    """
    rows = tokens.select(
        *tokens.columns, F.lit(-(2**63)).cast("bigint").alias("seq"), F.lit("save").alias("op")
    ).unionByName(changes.select(*tokens.columns, F.col("seq").cast("bigint").alias("seq"), "op"))
    return last_by(rows, ["user_id", "token"], [F.col("seq")]).filter(F.col("op") == "save").select(tokens.columns)
