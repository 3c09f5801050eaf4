"""Constraint audit: every violation of the table rules as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, rule: str, table: str, keys: list[str], n: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(table).alias("table"),
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).alias("key"),
        (n if n is not None else F.lit(1)).cast("bigint").alias("n"),
    )


def unique(df: DataFrame, table: str, keys: list[str], rule: str = "unique", where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return _report(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), rule, table, keys, F.col("n"))


def foreign_key(df: DataFrame, table: str, keys: list[str], parent: DataFrame, parent_keys: list[str], rule: str) -> DataFrame:
    """Distinct child keys without a parent; keys with a null part are not checked."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    child = df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    up = parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys)]).distinct()
    return _report(child.join(up, keys, "left_anti"), rule, table, keys, F.col("n"))


def check(df: DataFrame, table: str, keys: list[str], broken: Column, rule: str) -> DataFrame:
    return _report(df.filter(broken), rule, table, keys)


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations in the tables at hand: users, groups, group_members, sharing_permissions, medications, shares, ..."""
    t, found = tables, []
    if "users" in t:
        users = t["users"]
        found += [unique(users, "users", ["id"], "primary_key"), unique(users, "users", ["email"])]
        for c in [c for c in ("email", "name") if c in users.columns]:
            found.append(check(users, "users", ["id"], F.length(c) > 255, f"length_{c}"))
        if "gender" in users.columns:
            found.append(check(users, "users", ["id"], ~F.col("gender").isin("male", "female", "other"), "check_gender"))
    if "groups" in t:
        found += [
            unique(t["groups"], "groups", ["id"], "primary_key"),
            check(t["groups"], "groups", ["id"], F.col("name").isNull(), "not_null_name"),
            check(t["groups"], "groups", ["id"], F.length("name") > 255, "length_name"),
        ]
        if "users" in t:
            found.append(foreign_key(t["groups"], "groups", ["owner_id"], t["users"], ["id"], "fk_owner"))
    if "group_members" in t:
        m = t["group_members"]
        found += [
            unique(m, "group_members", ["group_id", "user_id"], "primary_key"),
            check(m, "group_members", ["group_id", "user_id"], F.col("invited_by").isNull(), "not_null_invited_by"),
        ]
        if "users" in t:
            found.append(foreign_key(m, "group_members", ["user_id"], t["users"], ["id"], "fk_user"))
            found.append(foreign_key(m, "group_members", ["invited_by"], t["users"], ["id"], "fk_invited_by"))
        if "groups" in t:
            found.append(foreign_key(m, "group_members", ["group_id"], t["groups"], ["id"], "fk_group"))
    if "sharing_permissions" in t:
        p, name = t["sharing_permissions"], "sharing_permissions"
        viewer = F.col("shared_with_user_id")
        found += [
            unique(p, name, ["group_id", "user_id", "metric_type"], "unique_global", viewer.isNull()),
            unique(p, name, ["group_id", "user_id", "metric_type", "shared_with_user_id"], "unique_viewer"),
            check(p, name, ["group_id", "user_id"], F.length("metric_type") > 50, "length_metric_type"),
        ]
        if "group_members" in t:
            m = t["group_members"]
            found.append(foreign_key(p, name, ["group_id", "user_id"], m, ["group_id", "user_id"], "fk_sharer"))
            found.append(foreign_key(p, name, ["group_id", "shared_with_user_id"], m, ["group_id", "user_id"], "fk_viewer"))
    if "metrics" in t:
        found.append(unique(t["metrics"], "metrics", ["metric_type", "user_id", "time"], "primary_key"))
        steps = (F.col("metric_type") == "steps_count") & (F.col("value") != F.floor("value"))
        found.append(check(t["metrics"], "metrics", ["metric_type", "user_id", "time"], steps, "integral_steps"))
        if "users" in t:
            found.append(foreign_key(t["metrics"], "metrics", ["user_id"], t["users"], ["id"], "fk_user"))
    if "thresholds" in t:
        found.append(unique(t["thresholds"], "thresholds", ["user_id", "metric_id"], "primary_key"))
        if "metric_types" in t:
            found.append(foreign_key(t["thresholds"], "thresholds", ["metric_id"], t["metric_types"], ["id"], "fk_metric"))
    if "medications" in t:
        found.append(unique(t["medications"], "medications", ["id"], "primary_key"))
        if "users" in t:
            found.append(foreign_key(t["medications"], "medications", ["user_id"], t["users"], ["id"], "fk_user"))
    if "reminders" in t:
        found.append(unique(t["reminders"], "reminders", ["id"], "primary_key"))
        found.append(check(t["reminders"], "reminders", ["id"], F.length("time") > 8, "length_time"))
        if "medications" in t:
            found.append(foreign_key(t["reminders"], "reminders", ["medication_id"], t["medications"], ["id"], "fk_medication"))
    if "shares" in t:
        found.append(unique(t["shares"], "shares", ["medication_id", "shared_with_user_id"]))
        if "users" in t:
            found.append(foreign_key(t["shares"], "shares", ["shared_with_user_id"], t["users"], ["id"], "fk_viewer"))
    if "tokens" in t:
        found.append(unique(t["tokens"], "tokens", ["user_id", "token"]))
    return reduce(lambda a, b: a.unionByName(b), found)
