"""Change sets over sharing permissions, groups and memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.asof import last_before
from vitalgrid.functions.skew import first_by, last_by
from vitalgrid.schemas import ACCESS_CONTROL
from vitalgrid.session import cut_lineage

SEQ_BUCKET = 100_000
BEFORE_ALL = -(2**62)
SCOPE = ["group_id", "user_id"]


def apply_permission_changes(
    perms: DataFrame, members: DataFrame, metric_types: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Permissions after changes in order of seq, and a verdict per change.

    ``changes``: seq, op, group_id, user_id (sharer), viewer_id, metrics.
    enable / disable take one metric, set replaces the list of its scope (the
    global one, or that of a viewer). A viewer list must lie within the global
    rows in force at that moment; a refused list still clears the viewer's old
    rows, as does an empty one. Global changes are therefore resolved first,
    then looked up as of each viewer change.
    """
    # read by every step below
    perms, members, changes = cut_lineage(perms), cut_lineage(members), cut_lineage(changes)
    # the catalog bounds this array
    valid = F.array_distinct(metric_types.agg(F.collect_set("name")).scalar())
    states = members.select("group_id", "user_id", "status")
    metrics = F.coalesce("metrics", F.array().cast("array<string>"))
    base_states = ("accepted", "pending_owner_approval")
    is_global = F.col("viewer_id").isNull()
    judged = (
        changes.withColumn("metrics", F.array_distinct(metrics))
        .join(states, SCOPE, "left")
        .withColumn(
            "verdict",
            F.when(F.size(F.array_except("metrics", valid)) > 0, "invalid_metric")
            .when(F.col("op") == "disable", "ok")
            .when((F.col("op") == "enable") & ~is_global, "use_list")
            .when(is_global & ~F.coalesce(F.col("status").isin(*base_states), F.lit(False)), "not_member")
            .when(~is_global & ~F.coalesce(F.col("status") == "accepted", F.lit(False)), "not_member")
            .otherwise("ok"),
        )
        .drop("status")
    )
    judged = cut_lineage(judged)
    effective = judged.filter(F.col("verdict") == "ok")
    global_flags = _global_events(perms, effective.filter(is_global), valid)

    # viewer lists: is every metric in the base at that moment?
    lists = effective.filter(~is_global & (F.col("op") == "set"))
    wanted = lists.filter(F.size("metrics") > 0).select("seq", *SCOPE, F.explode("metrics").alias("metric_type"))
    outside = (
        last_before(wanted, global_flags, [*SCOPE, "metric_type"], "seq", "present", "in_base", SEQ_BUCKET)
        .groupBy("seq")
        .agg(F.bool_and(F.coalesce("in_base", F.lit(False))).alias("within"))
    )
    lists = lists.join(outside, "seq", "left").withColumn("within", F.coalesce("within", F.lit(True)))
    verdicts = judged.join(outside, "seq", "left").select(
        "seq", F.when(F.col("within") == F.lit(False), "not_in_base").otherwise(F.col("verdict")).alias("verdict")
    )

    base = (
        global_flags.groupBy(*SCOPE, "metric_type")
        .agg(F.max_by("present", "seq").alias("present"))
        .filter("present")
        .select(*SCOPE, "metric_type", F.lit(None).cast(perms.schema["shared_with_user_id"].dataType).alias("shared_with_user_id"))
    )
    return base.unionByName(_viewer_rows(perms, lists, effective)), verdicts


def _global_events(perms: DataFrame, effective: DataFrame, valid: Column) -> DataFrame:
    """(scope, metric, seq, present): stored global rows and what each global change does to each metric."""
    stored = perms.filter(F.col("shared_with_user_id").isNull()).select(
        *SCOPE, "metric_type", F.lit(BEFORE_ALL).cast("bigint").alias("seq"), F.lit(True).alias("present")
    )
    single = effective.filter(F.col("op") != "set").select(
        *SCOPE, F.explode("metrics").alias("metric_type"), "seq", (F.col("op") == "enable").alias("present")
    )
    listed = effective.filter(F.col("op") == "set").select(
        *SCOPE, F.explode(valid).alias("metric_type"), "seq", "metrics"
    )
    listed = listed.withColumn("present", F.array_contains("metrics", F.col("metric_type"))).drop("metrics")
    return stored.unionByName(single).unionByName(listed)


def _viewer_rows(perms: DataFrame, lists: DataFrame, effective: DataFrame) -> DataFrame:
    """Viewer rows: the last list of a scope replaces the stored ones, later single removals apply."""
    scope = [*SCOPE, "shared_with_user_id"]
    last_list = last_by(
        lists.select(
            *SCOPE,
            F.col("viewer_id").alias("shared_with_user_id"),
            "seq",
            F.when(F.col("within") & (F.size("metrics") > 0), F.concat("metrics", F.array(F.lit(ACCESS_CONTROL))))
            .otherwise(F.array().cast("array<string>"))
            .alias("metrics"),
        ),
        scope,
        [F.col("seq")],
    )
    stored = (
        perms.filter(F.col("shared_with_user_id").isNotNull())
        .join(last_list.select(*scope), scope, "left_anti")
        .select(*scope, "metric_type", F.lit(BEFORE_ALL).cast("bigint").alias("seq"))
    )
    listed = last_list.select(*scope, F.explode("metrics").alias("metric_type"), "seq")
    removed = (
        effective.filter((F.col("op") == "disable") & F.col("viewer_id").isNotNull())
        .select(*SCOPE, F.col("viewer_id").alias("shared_with_user_id"), F.explode("metrics").alias("metric_type"), "seq")
        .groupBy(*scope, "metric_type")
        .agg(F.max("seq").alias("removed_seq"))
    )
    return (
        stored.unionByName(listed)
        .join(removed, [*scope, "metric_type"], "left")
        .filter(F.col("removed_seq").isNull() | (F.col("removed_seq") < F.col("seq")))
        .select(*SCOPE, "metric_type", "shared_with_user_id")
    )


def cascade_delete(
    groups: DataFrame, members: DataFrame, perms: DataFrame, deletes: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables after one round of removals, and a verdict per request.

    ``deletes``: seq, kind, group_id, user_id, requester_id. kick needs the
    group's owner and another target, leave must not come from the owner,
    group needs the owner and no other member. A member that other sharers
    name as viewer is held back by the foreign key (blocked_fk).
    """
    # every input is judged by and cut again below
    groups, members, perms = cut_lineage(groups), cut_lineage(members), cut_lineage(perms)
    owners = groups.select(F.col("id").alias("group_id"), "owner_id")
    counts = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    known = members.select("group_id", "user_id", F.lit(True).alias("is_member"))
    named = (
        perms.filter(F.col("shared_with_user_id").isNotNull() & (F.col("shared_with_user_id") != F.col("user_id")))
        .select("group_id", F.col("shared_with_user_id").alias("user_id"))
        .distinct()
        .withColumn("is_named", F.lit(True))
    )
    is_owner = F.col("requester_id") == F.col("owner_id")
    kick, leave, whole = (F.col("kind") == k for k in ("kick", "leave", "group"))
    judged = (
        deletes.join(owners, "group_id", "left")
        .join(counts, "group_id", "left")
        .join(known, SCOPE, "left")
        .join(named, SCOPE, "left")
        .withColumn(
            "verdict",
            F.when(F.col("owner_id").isNull(), "invalid_group")
            .when((kick | whole) & ~is_owner, "not_owner")
            .when(kick & (F.col("user_id") == F.col("requester_id")), "owner_cannot_be_kicked")
            .when(leave & (F.col("user_id") == F.col("owner_id")), "owner_cannot_leave")
            .when(whole & (F.col("members") > 1), "not_empty")
            .when(whole, "deleted")
            .when(F.col("is_named"), "blocked_fk")
            .when(F.col("is_member").isNull(), "member_not_found")
            .otherwise("deleted"),
        )
    )
    judged = cut_lineage(judged)
    done = judged.filter(F.col("verdict") == "deleted")
    gone_groups = done.filter(F.col("kind") == "group").select("group_id").distinct()
    gone_members = done.filter(F.col("kind") != "group").select(*SCOPE).distinct()
    tables = {
        "groups": groups.join(gone_groups.withColumnRenamed("group_id", "id"), "id", "left_anti").select(groups.columns),
        "members": members.join(gone_groups, "group_id", "left_anti").join(gone_members, SCOPE, "left_anti").select(members.columns),
        "permissions": perms.join(gone_groups, "group_id", "left_anti").join(gone_members, SCOPE, "left_anti").select(perms.columns),
    }
    return tables, judged.select("seq", "verdict")


def transfer_ownership(
    groups: DataFrame, members: DataFrame, users: DataFrame, transfers: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, verdicts) after one round of transfers: seq, group_id, requester_id, new_owner_id, at.

    The owner must ask; the new owner must be a user and an accepted member, or
    nothing changes. A group changes hands once a round: the first valid
    transfer, later ones find themselves asked by a former owner.
    """
    owners = groups.select(F.col("id").alias("group_id"), "owner_id")
    people = users.select(F.col("id").alias("new_owner_id"), F.lit(True).alias("exists"))
    joined = members.filter(F.col("status") == "accepted").select(
        "group_id", F.col("user_id").alias("new_owner_id"), F.lit(True).alias("is_member")
    )
    judged = (
        transfers.join(owners, "group_id", "left")
        .join(people, "new_owner_id", "left")
        .join(joined, ["group_id", "new_owner_id"], "left")
        .withColumn(
            "verdict",
            F.when(F.col("owner_id").isNull(), "invalid_group")
            .when(F.col("owner_id") != F.col("requester_id"), "not_owner")
            .when(F.col("exists").isNull(), "not_owner")
            .when(F.col("new_owner_id") == F.col("requester_id"), "unchanged")
            .when(F.col("is_member").isNull(), "not_member")
            .otherwise("transferred"),
        )
    )
    first = judged.filter(F.col("verdict") == "transferred").groupBy("group_id").agg(
        F.min_by(F.struct("seq", F.col("owner_id").alias("old"), F.col("new_owner_id").alias("new")), "seq").alias("t")
    )
    verdicts = judged.join(first, "group_id", "left").select(
        "seq",
        F.when(F.col("verdict").isin("transferred", "unchanged", "not_member") & (F.col("seq") > F.col("t.seq")), "not_owner")
        .otherwise(F.col("verdict"))
        .alias("verdict"),
    )
    new_groups = groups.join(first.withColumnRenamed("group_id", "id"), "id", "left").select(
        *[F.coalesce("t.new", "owner_id").alias(c) if c == "owner_id" else F.col(c) for c in groups.columns]
    )
    role = (
        F.when(F.col("user_id") == F.col("t.new"), "owner").when(F.col("user_id") == F.col("t.old"), "member").otherwise(F.col("role"))
    )
    new_members = members.join(first, "group_id", "left").select(
        *[role.alias(c) if c == "role" else F.col(c) for c in members.columns]
    )
    return new_groups, new_members, verdicts


def bulk_groups(groups: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new groups, their owner memberships, verdicts) for requests: seq, id, owner_id, name, description, at."""
    people = users.select(F.col("id").alias("owner_id"), F.lit(True).alias("exists"))
    taken = groups.select("owner_id", "name", F.lit(True).alias("taken")).distinct()
    fits = F.octet_length("name").between(3, 100)
    judged = (
        requests.join(people, "owner_id", "left")
        .join(taken, ["owner_id", "name"], "left")
        .withColumn(
            "verdict",
            F.when(~fits, "invalid_name").when(F.col("exists").isNull(), "not_owner").when(F.col("taken"), "already_exists").otherwise("ok"),
        )
        .drop("exists", "taken")
    )
    won = first_by(judged.filter(F.col("verdict") == "ok"), ["owner_id", "name"], [F.col("seq")])
    verdicts = judged.join(won.select("seq", F.lit(True).alias("won")), "seq", "left").select(
        "seq",
        F.when((F.col("verdict") == "ok") & F.col("won").isNull(), "already_exists").otherwise(F.col("verdict")).alias("verdict"),
    )
    made = won.select("id", "name", "description", "owner_id", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    owner_rows = won.select(
        F.col("id").alias("group_id"), F.col("owner_id").alias("user_id"), F.col("owner_id").alias("invited_by"),
        F.lit("owner").alias("role"), F.lit("accepted").alias("status"), F.col("at").alias("joined_at"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )
    return made, owner_rows, verdicts


def patch_groups(groups: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups after patches (seq, id, requester_id, name, description; null = unchanged), and verdicts."""
    owners = groups.select("id", "owner_id")
    judged = patches.join(owners, "id", "left").withColumn(
        "verdict",
        F.when(F.col("owner_id").isNull(), "not_found")
        .when(F.col("owner_id") != F.col("requester_id"), "not_owner")
        .when(F.col("name").isNotNull() & ~F.octet_length("name").between(3, 100), "invalid_name")
        .otherwise("ok"),
    )
    fields = [c for c in ("name", "description") if c in groups.columns]
    last = judged.filter(F.col("verdict") == "ok").groupBy("id").agg(
        F.struct(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]).alias("p")
    )
    table = groups.join(last, "id", "left").select(
        *[F.coalesce(f"p.{c}", c).alias(c) if c in fields else F.col(c) for c in groups.columns]
    )
    return table, judged.select("seq", "verdict")


ANSWERS = ("pending_owner_approval", "rejected")


def membership_events(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Events joined to their group: is the group there, and does its owner act?"""
    owners = groups.select(F.col("id").alias("group_id"), "owner_id")
    # an invitee who accepts asks for the owner's approval
    asked = F.when(F.col("status") == "accepted", "pending_owner_approval").otherwise(F.col("status"))
    return events.join(owners, "group_id", "left").select(
        *SCOPE,
        "seq",
        "action",
        "actor_id",
        "ts",
        F.coalesce(asked, F.lit("")).alias("asked"),
        F.coalesce(F.col("owner_id") == F.col("actor_id"), F.lit(False)).alias("is_owner"),
        F.col("owner_id").isNotNull().alias("group_found"),
    )


def membership_steps(events: DataFrame, groups: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Verdict, and status before and after, of each event.

    ``events``: seq, group_id, user_id, actor_id, action (invite, respond,
    approve, reject), status (asked for by respond), ts. ``members`` holds the
    statuses to start from. A status only ever advances: invited, answered,
    decided. So the fold is three "first event after" aggregates per
    membership, whatever the length of its history.
    """
    rows = membership_events(events, groups)
    keys = rows.select(*SCOPE).distinct()
    if members is None:
        start = keys.withColumn("initial", F.lit("none"))
    else:
        known = members.select(*SCOPE, F.col("status").alias("initial"))
        start = keys.join(known, SCOPE, "left").withColumn("initial", F.coalesce("initial", F.lit("none")))
    before_all = F.lit(BEFORE_ALL).cast("bigint")
    invited = (
        rows.filter((F.col("action") == "invite") & F.col("group_found")).groupBy(*SCOPE).agg(F.min("seq").alias("first_invite"))
    )
    opened = start.join(invited, SCOPE, "left").withColumn(
        "t1", F.when(F.col("initial") == "none", F.col("first_invite")).when(F.col("initial") == "pending", before_all)
    )
    answers = rows.filter((F.col("action") == "respond") & F.col("asked").isin(*ANSWERS))
    answered = (
        answers.join(opened.select(*SCOPE, "t1"), SCOPE)
        .filter(F.col("seq") > F.col("t1"))
        .groupBy(*SCOPE)
        .agg(F.min_by(F.struct(F.col("seq").alias("t2"), "asked"), "seq").alias("a"))
        .select(*SCOPE, "a.t2", F.col("a.asked").alias("answer"))
    )
    waiting = (
        opened.select(*SCOPE, "initial", "t1")
        .join(answered, SCOPE, "left")
        .withColumn("from", F.when(F.col("answer") == "pending_owner_approval", F.col("t2")).when(F.col("initial") == "pending_owner_approval", before_all))
    )
    decisions = rows.filter(F.col("action").isin("approve", "reject") & F.col("is_owner"))
    decided = (
        decisions.join(waiting.select(*SCOPE, "from"), SCOPE)
        .filter(F.col("seq") > F.col("from"))
        .groupBy(*SCOPE)
        .agg(F.min_by(F.struct(F.col("seq").alias("t3"), "action"), "seq").alias("d"))
        .select(*SCOPE, "d.t3", F.when(F.col("d.action") == "approve", "accepted").otherwise("rejected").alias("decision"))
    )
    path = waiting.join(decided, SCOPE, "left").select(*SCOPE, "initial", "t1", "t2", "answer", "t3", "decision")

    def status(reached) -> Column:
        return (
            F.when(reached("t3"), F.col("decision"))
            .when(reached("t2"), F.col("answer"))
            .when(reached("t1"), F.lit("pending"))
            .otherwise(F.col("initial"))
        )

    return (
        rows.join(path, SCOPE)
        .withColumn("before", status(lambda t: F.col(t) < F.col("seq")))
        .withColumn("after", status(lambda t: F.col(t) <= F.col("seq")))
        .select(*SCOPE, "seq", "actor_id", "ts", "before", "after", membership_verdict().alias("verdict"))
    )


def membership_verdict() -> Column:
    action, before, asked = F.col("action"), F.col("before"), F.col("asked")
    return (
        F.when(
            action == "invite",
            F.when(~F.col("group_found"), "invalid_group").when(before != "none", "already_member").otherwise("ok"),
        )
        .when(
            action == "respond",
            F.when(before == "none", "not_found")
            .when(before == asked, "unchanged")
            .when((before != "pending") | ~asked.isin(*ANSWERS), "invalid_status")
            .otherwise("ok"),
        )
        .otherwise(
            F.when(~F.col("is_owner"), "not_owner")
            .when(before == "none", "not_found")
            .when(before != "pending_owner_approval", "not_pending_approval")
            .otherwise("ok")
        )
    )


def membership_state(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Memberships after all events; joined_at is set by an approval only."""
    done = membership_steps(events, groups).filter(F.col("verdict") == "ok")
    return done.groupBy(*SCOPE).agg(
        F.max_by("after", "seq").alias("status"),
        F.min_by("actor_id", "seq").alias("invited_by"),
        F.min_by("ts", "seq").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("after") == "accepted", F.col("ts"))).alias("joined_at"),
    )
