"""Two-tier sharing rule over sets of requests.

Base tier: a global row (no viewer) of the sharer in the group is mandatory.
Filter tier: if the sharer wrote an access_control row for the viewer, the
viewer also needs a row for the metric itself; otherwise the base tier decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.schemas import ACCESS_CONTROL


def base_rows(perms: DataFrame) -> DataFrame:
    """Global rows as (group_id, owner_id, metric_type)."""
    return perms.filter(F.col("shared_with_user_id").isNull()).select(
        "group_id", F.col("user_id").alias("owner_id"), "metric_type"
    )


def viewer_rules(perms: DataFrame) -> DataFrame:
    """One row per (group, owner, viewer): is a filter on, and which metrics pass it.

    The metric list cannot outgrow the metric catalog, so the aggregate stays small.
    """
    return (
        perms.filter(F.col("shared_with_user_id").isNotNull())
        .groupBy("group_id", F.col("user_id").alias("owner_id"), F.col("shared_with_user_id").alias("viewer_id"))
        .agg(
            F.bool_or(F.col("metric_type") == ACCESS_CONTROL).alias("has_filter"),
            F.collect_set("metric_type").alias("passed"),
        )
    )


def accepted(members: DataFrame, who: str) -> DataFrame:
    return members.filter(F.col("status") == "accepted").select("group_id", F.col("user_id").alias(who))


def passes_filter() -> Column:
    """True when no filter is on for the viewer, or the metric is listed in it."""
    return ~F.coalesce("has_filter", F.lit(False)) | F.array_contains("passed", F.col("metric_type"))


def authorised_members(requests: DataFrame, perms: DataFrame, members: DataFrame) -> DataFrame:
    """(owner_id, metric_type, group_id, viewer_id) the rule lets through, for requested owner-metric pairs."""
    shared = (
        requests.select("owner_id", "metric_type")
        .distinct()
        .join(base_rows(perms), ["owner_id", "metric_type"])
        .join(accepted(members, "owner_id"), ["group_id", "owner_id"], "left_semi")
    )
    candidates = shared.join(accepted(members, "viewer_id"), "group_id").filter(
        F.col("viewer_id") != F.col("owner_id")
    )
    return (
        candidates.join(viewer_rules(perms), ["group_id", "owner_id", "viewer_id"], "left")
        .filter(passes_filter())
        .select("owner_id", "metric_type", "group_id", "viewer_id")
    )


def metric_watchers(
    requests: DataFrame, perms: DataFrame, members: DataFrame, users: DataFrame, groups: DataFrame
) -> DataFrame:
    """Distinct (watcher, watcher name, group name) per requested pair; groups of one name collapse."""
    return (
        authorised_members(requests, perms, members)
        .join(users.select(F.col("id").alias("viewer_id"), F.col("name").alias("watcher_name")), "viewer_id")
        .join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id")
        .select("owner_id", "metric_type", F.col("viewer_id").alias("watcher_id"), "watcher_name", "group_name")
        .distinct()
    )


def stream_watchers(requests: DataFrame, perms: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (watcher, group id, group name) per requested pair."""
    return (
        authorised_members(requests, perms, members)
        .join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id")
        .select("owner_id", "metric_type", F.col("viewer_id").alias("watcher_id"), "group_id", "group_name")
        .distinct()
    )


def check_access(requests: DataFrame, perms: DataFrame, members: DataFrame, own: str = "allow") -> DataFrame:
    """Verdict per distinct (observer_id, target_id, metric_type).

    ``own`` decides requests for one's own data: "allow" (charts) or "error"
    (streams refuse them).
    """
    if own not in ("allow", "error"):
        raise ValueError("own must be 'allow' or 'error'")
    asked = requests.select("observer_id", "target_id", "metric_type").distinct()
    granted = (
        asked.filter(F.col("observer_id") != F.col("target_id"))
        .join(base_rows(perms).withColumnRenamed("owner_id", "target_id"), ["target_id", "metric_type"])
        .join(accepted(members, "target_id"), ["group_id", "target_id"], "left_semi")
        .join(accepted(members, "observer_id"), ["group_id", "observer_id"], "left_semi")
        .join(
            viewer_rules(perms)
            .withColumnRenamed("owner_id", "target_id")
            .withColumnRenamed("viewer_id", "observer_id"),
            ["group_id", "target_id", "observer_id"],
            "left",
        )
        .filter(passes_filter())
        .select("observer_id", "target_id", "metric_type")
        .distinct()
        .withColumn("granted", F.lit(True))
    )
    is_own = F.col("observer_id") == F.col("target_id")
    own_verdict = F.lit("allowed" if own == "allow" else "self_not_allowed")
    return asked.join(granted, ["observer_id", "target_id", "metric_type"], "left").select(
        "observer_id",
        "target_id",
        "metric_type",
        F.when(is_own, own_verdict)
        .when(F.col("granted"), F.lit("allowed"))
        .otherwise(F.lit("denied"))
        .alias("verdict"),
    )


def visible_metrics(perms: DataFrame, members: DataFrame, viewers: DataFrame) -> DataFrame:
    """Per (group_id, viewer_id): each accepted sharer and the metrics listed for the viewer.

    With an access_control row for the viewer these are the viewer's own rows
    (the base tier is not consulted here), otherwise the sharer's global rows.
    """
    asked = viewers.select("group_id", "viewer_id").distinct()
    sharers = perms.select("group_id", F.col("user_id").alias("member_id"), "metric_type", "shared_with_user_id").join(
        accepted(members, "member_id"), ["group_id", "member_id"], "left_semi"
    )
    specific = sharers.filter(F.col("shared_with_user_id").isNotNull()).withColumnRenamed(
        "shared_with_user_id", "viewer_id"
    )
    own_rules = (
        specific.join(asked, ["group_id", "viewer_id"], "left_semi")
        .groupBy("group_id", "viewer_id", "member_id")
        .agg(
            F.bool_or(F.col("metric_type") == ACCESS_CONTROL).alias("has_filter"),
            F.array_remove(F.collect_set("metric_type"), ACCESS_CONTROL).alias("metrics"),
        )
        .filter("has_filter")
        .filter(F.col("member_id") != F.col("viewer_id"))
    )
    shared = (
        sharers.filter(F.col("shared_with_user_id").isNull() & (F.col("metric_type") != ACCESS_CONTROL))
        .groupBy("group_id", "member_id")
        .agg(F.collect_set("metric_type").alias("metrics"))
    )
    fallback = (
        asked.join(shared, "group_id")
        .filter(F.col("member_id") != F.col("viewer_id"))
        .join(own_rules.select("group_id", "viewer_id", "member_id"), ["group_id", "viewer_id", "member_id"], "left_anti")
    )
    cols = ["group_id", "viewer_id", "member_id", F.sort_array("metrics").alias("metrics")]
    return (
        own_rules.filter(F.size("metrics") > 0).select(*cols).unionByName(fallback.select(*cols))
    )


def orphan_permissions(perms: DataFrame) -> DataFrame:
    """Viewer rows without an access_control row of the same sharer, group and viewer."""
    specific = perms.filter(F.col("shared_with_user_id").isNotNull() & (F.col("metric_type") != ACCESS_CONTROL))
    marks = perms.filter(F.col("shared_with_user_id").isNotNull() & (F.col("metric_type") == ACCESS_CONTROL))
    return specific.join(marks, ["group_id", "user_id", "shared_with_user_id"], "left_anti").select(perms.columns)


def permissions_for(perms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of a sharer in a group; with a viewer, that viewer's rows and the global ones.

    ``pairs``: request_id, group_id, user_id, viewer_id (null = all rows).
    """
    rows = perms.join(pairs, ["group_id", "user_id"])
    keep = (
        F.col("viewer_id").isNull()
        | F.col("shared_with_user_id").isNull()
        | (F.col("shared_with_user_id") == F.col("viewer_id"))
    )
    return rows.filter(keep).select("request_id", "group_id", "user_id", "metric_type", "shared_with_user_id")


def permission_summary(perms: DataFrame) -> DataFrame:
    """Per (group, sharer): global metrics, and viewers with their metrics; access_control rows are not shown.

    A list of viewers is bounded by the group's size; viewers are first reduced
    to one row each, so only that reduced form is gathered per sharer.
    """
    shown = perms.filter(F.col("metric_type") != ACCESS_CONTROL)
    global_part = (
        shown.filter(F.col("shared_with_user_id").isNull())
        .groupBy("group_id", "user_id")
        .agg(F.sort_array(F.collect_set("metric_type")).alias("global"))
    )
    specific_part = (
        shown.filter(F.col("shared_with_user_id").isNotNull())
        .groupBy("group_id", "user_id", "shared_with_user_id")
        .agg(F.sort_array(F.collect_set("metric_type")).alias("metrics"))
        .groupBy("group_id", "user_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("shared_with_user_id").alias("viewer_id"), F.col("metrics")))
            ).alias("specific")
        )
    )
    keys = perms.select("group_id", "user_id").distinct()
    return (
        keys.join(global_part, ["group_id", "user_id"], "left")
        .join(specific_part, ["group_id", "user_id"], "left")
        .select(
            "group_id",
            "user_id",
            F.coalesce("global", F.array().cast("array<string>")).alias("global"),
            F.coalesce("specific", F.array().cast("array<struct<viewer_id:bigint,metrics:array<string>>>")).alias(
                "specific"
            ),
        )
    )
