"""Queries: users, groups, memberships, change sets, audit."""

from pyspark.sql import functions as F

from vitalgrid.operators import audit, changes, people
from vitalgrid.plans.registry import query
from vitalgrid.sources.tables import as_instants

VIEWS = ["v_users", "v_groups", "v_group_members"]

NAME = "COALESCE(NULLIF(TRIM(u.name), ''), NULLIF(SPLIT_PART(COALESCE(u.email, ''), '@', 1), ''), '')"


@query(
    "member_display",
    f"SELECT m.group_id, m.user_id, m.status, {NAME} AS name, COALESCE(u.email, '') AS email FROM v_group_members m JOIN v_users u ON u.id = m.user_id WHERE m.status = 'accepted'",
    VIEWS,
)
def member_display(ds):
    out = people.member_display(ds.view("v_group_members"), ds.view("v_users"))
    return out.select("group_id", "user_id", "status", "name", "email")


@query(
    "member_any_status",
    f"SELECT m.group_id, m.user_id, m.status, {NAME} AS name, COALESCE(u.email, '') AS email FROM v_group_members m JOIN v_users u ON u.id = m.user_id",
    VIEWS,
)
def member_any_status(ds):
    out = people.member_display(ds.view("v_group_members"), ds.view("v_users"), only_accepted=False)
    return out.select("group_id", "user_id", "status", "name", "email")


@query(
    "search_users",
    "SELECT id, name, email, status, created_at FROM v_users WHERE status = 'active' AND (name ILIKE '%R12%' OR email ILIKE '%R12%') ORDER BY created_at DESC, id LIMIT 100 OFFSET 5",
    VIEWS,
)
def search_users(ds):
    out = people.search_users(ds.view("v_users"), status="active", search="R12", limit=1000, offset=5)
    return out.select("id", "name", "email", "status", "created_at")


@query(
    "search_groups",
    "SELECT id, name, owner_id, created_at FROM v_groups WHERE name ILIKE '%a%' ORDER BY created_at DESC, id LIMIT 10 OFFSET 3",
    VIEWS,
)
def search_groups(ds):
    return people.search_groups(ds.view("v_groups"), search="a", limit=10, offset=3).select("id", "name", "owner_id", "created_at")


@query(
    "groups_of_user",
    """SELECT user_id, group_id, name, position FROM (SELECT m.user_id, g.id AS group_id, g.name, CAST(ROW_NUMBER() OVER (PARTITION BY m.user_id ORDER BY g.created_at DESC, g.id) AS INT) AS position
 FROM v_group_members m JOIN v_groups g ON g.id = m.group_id WHERE m.status = 'accepted') WHERE position BETWEEN 2 AND 3""",
    VIEWS,
)
def groups_of_user(ds):
    return people.groups_of_user(ds.view("v_groups"), ds.view("v_group_members"), 2, 1).select("user_id", "group_id", "name", "position")


@query(
    "groups_of_owner",
    """SELECT owner_id, group_id, position FROM (SELECT owner_id, id AS group_id, CAST(ROW_NUMBER() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id) AS INT) AS position FROM v_groups) WHERE position <= 2""",
    VIEWS,
)
def groups_of_owner(ds):
    return people.groups_of_owner(ds.view("v_groups"), 2).select("owner_id", "group_id", "position")


KEYS = """SELECT o_orderkey AS seq, o_custkey * 2 AS user_id, CAST(FLOOR(o_custkey / 60) AS BIGINT) + CASE WHEN o_orderkey % 6 = 0 THEN 900000 ELSE 0 END AS group_id, o_orderpriority AS metric FROM orders"""


@query(
    "bulk_exists",
    """SELECT k.seq, EXISTS (SELECT 1 FROM v_users u WHERE u.id = k.user_id) AS is_user, EXISTS (SELECT 1 FROM v_groups g WHERE g.id = k.group_id) AS is_group,
 EXISTS (SELECT 1 FROM v_groups g WHERE g.id = k.group_id AND g.owner_id = k.user_id) AS is_owner,
 EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = k.group_id AND m.user_id = k.user_id AND m.status = 'accepted') AS is_member,
 EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = k.group_id AND m.user_id = k.user_id AND m.status IN ('accepted', 'pending_owner_approval')) AS may_share,
 EXISTS (SELECT 1 FROM v_metric_types t WHERE t.name = k.metric) AS is_metric FROM keys k""",
    [*VIEWS, "v_metric_types"],
    [("keys", KEYS)],
)
def bulk_exists(ds):
    members = ds.view("v_group_members")
    pair = {"group_id": "group_id", "user_id": "user_id"}
    out = people.bulk_exists(ds.sql(KEYS), ds.view("v_users"), {"user_id": "id"}, "is_user")
    out = people.bulk_exists(out, ds.view("v_groups"), {"group_id": "id"}, "is_group")
    out = people.bulk_exists(out, ds.view("v_groups"), {"group_id": "id", "user_id": "owner_id"}, "is_owner")
    out = people.bulk_exists(out, members.filter("status = 'accepted'"), pair, "is_member")
    out = people.bulk_exists(out, members.filter("status IN ('accepted', 'pending_owner_approval')"), pair, "may_share")
    out = people.bulk_exists(out, ds.view("v_metric_types"), {"metric": "name"}, "is_metric")
    return out.select("seq", "is_user", "is_group", "is_owner", "is_member", "may_share", "is_metric")


@query(
    "bulk_lookup",
    """SELECT k.seq, CASE WHEN u.id IS NULL THEN 'Unknown User' ELSE u.name END AS name, e.id AS by_email, g.id AS by_name_and_owner FROM keys k LEFT JOIN v_users u ON u.id = k.user_id
 LEFT JOIN v_users e ON e.email = 'user' || CAST(k.seq AS VARCHAR) || '@example.com' LEFT JOIN v_groups g ON g.name = 'team 1' AND g.owner_id = k.user_id""",
    VIEWS,
    [("keys", KEYS)],
)
def bulk_lookup(ds):
    keys = ds.sql(KEYS).select(
        "seq", "user_id", F.concat(F.lit("user"), F.col("seq").cast("string"), F.lit("@example.com")).alias("email"), F.lit("team 1").alias("group")
    )
    names = people.user_names(keys.select("user_id").distinct(), ds.view("v_users"))
    out = keys.join(names, "user_id")
    out = people.bulk_lookup(out, ds.view("v_users"), {"email": "email"}, {"by_email": "id"}).drop("found")
    out = people.bulk_lookup(out, ds.view("v_groups"), {"group": "name", "user_id": "owner_id"}, {"by_name_and_owner": "id"})
    return out.select("seq", "name", "by_email", "by_name_and_owner")


NAMED = """SELECT id, owner_id % 3 AS owner_id, CASE WHEN id % 6 = 0 THEN 'ab' WHEN id % 6 = 1 THEN 'family' WHEN id % 6 = 2 THEN 'đó' WHEN id % 6 = 3 THEN repeat('x', 101) ELSE name END AS name FROM
 (SELECT o_orderkey AS id, o_custkey AS owner_id, 'team ' || CAST(o_orderkey % 4000 AS VARCHAR(9)) AS name FROM orders)"""


@query(
    "group_name_check",
    """SELECT id, CASE WHEN strlen(name) NOT BETWEEN 3 AND 100 THEN 'bad_length' WHEN COUNT(*) OVER (PARTITION BY owner_id, name) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM named""",
    VIEWS,
    [("named", NAMED)],
)
def group_name_check(ds):
    return people.group_name_check(ds.sql(NAMED)).select("id", "verdict")


ALLERGIES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ' Penicillin |penicillin||  |' || c_name || '|Dust|' || repeat('x', 120) || '|DUST| ' || c_mktsegment END AS listed FROM customer"""


@query(
    "clean_allergies",
    """SELECT c.c_custkey AS id, CASE WHEN c.c_custkey % 9 = 0 THEN '' ELSE 'Penicillin|' || c.c_name || '|Dust|' || repeat('x', 100) || '|' || c.c_mktsegment END AS allergies, TRUE AS accepted FROM customer c""",
    VIEWS,
)
def clean_allergies(ds):
    rows = ds.sql(ALLERGIES).select("id", F.split("listed", r"\|").alias("allergies"))
    return people.clean_allergies(rows).withColumn("allergies", F.array_join("allergies", "|"))


PROFILES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '0901' END AS phone, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'male' END AS gender,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS weight,
 CASE c_custkey % 6 WHEN 0 THEN '1990-05-06' WHEN 1 THEN '1990-05-06T23:30:00-07:00' WHEN 2 THEN '' WHEN 3 THEN '06/05/1990' WHEN 4 THEN '1990-02-30' END AS birthday FROM customer"""


@query(
    "normalize_profiles",
    """SELECT id, NULLIF(phone, '') AS phone, NULLIF(gender, '') AS gender, CASE WHEN weight <> 0 THEN weight END AS weight,
 CASE WHEN birthday LIKE '1990-05-06%' THEN DATE '1990-05-06' END AS birthday, 0 AS allergies FROM profiles""",
    VIEWS,
    [("profiles", PROFILES)],
)
def normalize_profiles(ds):
    rows = ds.sql(PROFILES).withColumn("allergies", F.lit(None).cast("array<string>"))
    return people.normalize_profiles(rows).withColumn("allergies", F.size("allergies"))


@query(
    "group_sizes",
    """SELECT g.id, COUNT(m.user_id) FILTER (WHERE m.status = 'accepted') AS accepted, COUNT(m.user_id) AS members, COUNT(m.user_id) <= 1 AS may_delete
 FROM v_groups g LEFT JOIN v_group_members m ON m.group_id = g.id GROUP BY g.id""",
    VIEWS,
)
def group_sizes(ds):
    return people.group_sizes(ds.view("v_groups"), ds.view("v_group_members"))


@query(
    "user_invitations",
    """SELECT m.group_id AS id, m.created_at AS sent_at, g.name AS group_name, (SELECT COUNT(*) FROM v_group_members c WHERE c.group_id = g.id AND c.status = 'accepted') AS member_count,
 i.id AS inviter_id, i.name AS inviter_name, t.id AS invitee_id, t.email AS invitee_email
FROM v_group_members m JOIN v_groups g ON g.id = m.group_id JOIN v_users i ON i.id = m.invited_by JOIN v_users t ON t.id = m.user_id WHERE m.status = 'pending'""",
    VIEWS,
)
def user_invitations(ds):
    out = people.user_invitations(ds.view("v_group_members"), ds.view("v_groups"), ds.view("v_users"))
    return out.select(
        "id", "sent_at", F.col("group.name").alias("group_name"), F.col("group.member_count").alias("member_count"),
        F.col("inviter.id").alias("inviter_id"), F.col("inviter.name").alias("inviter_name"),
        F.col("invite_to.id").alias("invitee_id"), F.col("invite_to.email").alias("invitee_email"),
    )


# Requests by owners, by members who sent invitations, and into missing groups.
REQUESTERS = """SELECT id * 10 + 1 AS request_id, id AS group_id, owner_id AS requester_id FROM v_groups
 UNION ALL SELECT group_id * 1000000 + user_id + 500000, group_id, user_id FROM v_group_members WHERE user_id % 60 BETWEEN 1 AND 5
 UNION ALL SELECT id * 10 + 2, id + 1000, owner_id FROM v_groups"""

OPEN = """SELECT m.group_id, m.user_id, u.email AS user_email, u.name AS user_name, m.invited_by, i.name AS inviter_name, m.status, m.created_at
 FROM v_group_members m JOIN v_users u ON u.id = m.user_id JOIN v_users i ON i.id = m.invited_by WHERE m.status IN ('pending', 'pending_owner_approval')"""


def requesters(ds):
    return ds.sql(REQUESTERS, VIEWS)


@query(
    "group_invitations",
    """SELECT q.request_id, q.requester_id, o.* FROM requesters q JOIN v_groups g ON g.id = q.group_id
 JOIN v_group_members me ON me.group_id = q.group_id AND me.user_id = q.requester_id AND me.status = 'accepted'
 JOIN opened o ON o.group_id = q.group_id WHERE g.owner_id = q.requester_id OR o.invited_by = q.requester_id""",
    VIEWS,
    [("requesters", REQUESTERS), ("opened", OPEN)],
)
def group_invitations(ds):
    return people.group_invitations(ds.view("v_group_members"), ds.view("v_users"), ds.view("v_groups"), requesters(ds))


@query(
    "invitation_verdicts",
    """SELECT q.request_id, CASE WHEN g.id IS NULL THEN 'invalid_group' WHEN NOT EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = q.group_id AND m.user_id = q.requester_id AND m.status = 'accepted')
 THEN 'not_member' ELSE 'ok' END AS verdict FROM requesters q LEFT JOIN v_groups g ON g.id = q.group_id""",
    VIEWS,
    [("requesters", REQUESTERS)],
)
def invitation_verdicts(ds):
    return people.invitation_verdicts(ds.view("v_group_members"), ds.view("v_groups"), requesters(ds))


@query(
    "pending_approvals",
    """SELECT q.request_id, q.requester_id, o.* FROM requesters q JOIN v_groups g ON g.id = q.group_id AND g.owner_id = q.requester_id
 JOIN opened o ON o.group_id = q.group_id WHERE o.status = 'pending_owner_approval'""",
    VIEWS,
    [("requesters", REQUESTERS), ("opened", OPEN)],
)
def pending_approvals(ds):
    return people.pending_approvals(ds.view("v_group_members"), ds.view("v_users"), ds.view("v_groups"), requesters(ds))


# A profile patch per order: some empty, some clearing the birthday.
PATCHES = """SELECT o_orderkey AS seq, o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name,
 CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '1990-05-06' END END AS birthday, CASE WHEN o_orderkey % 5 = 0 THEN 'Asia/Tokyo' END AS timezone FROM orders"""


@query(
    "apply_profile_patches",
    """SELECT u.id, COALESCE((SELECT p.name FROM patches p WHERE p.id = u.id AND p.name IS NOT NULL ORDER BY p.seq DESC LIMIT 1), u.name) AS name,
 CAST(NULLIF((SELECT p.birthday FROM patches p WHERE p.id = u.id AND p.birthday IS NOT NULL ORDER BY p.seq DESC LIMIT 1), '') AS DATE) AS birthday,
 COALESCE((SELECT p.timezone FROM patches p WHERE p.id = u.id AND p.timezone IS NOT NULL ORDER BY p.seq DESC LIMIT 1), u.timezone) AS timezone FROM v_users u""",
    VIEWS,
    [("patches", PATCHES)],
)
def apply_profile_patches(ds):
    users = ds.view("v_users").withColumn("birthday", F.lit(None).cast("date"))
    table, _ = people.apply_profile_patches(users, ds.sql(PATCHES))
    return table.select("id", "name", "birthday", "timezone")


PERMISSION_CHANGES = """SELECT o_orderkey * 100 + m.group_id AS seq, CASE WHEN o_orderkey % 11 < 4 THEN 'enable' WHEN o_orderkey % 11 < 7 THEN 'disable' ELSE 'set' END AS op,
 m.group_id, m.user_id, CASE WHEN o_orderkey % 3 = 1 THEN m.user_id % 20 + 1 END AS viewer_id,
 CASE WHEN o_orderkey % 13 = 0 THEN 'mood' WHEN o_orderkey % 5 = 0 THEN 'heart_rate' WHEN o_orderkey % 5 = 1 THEN 'spo2' WHEN o_orderkey % 5 = 2 THEN 'weight' WHEN o_orderkey % 5 = 3 AND o_orderkey % 11 >= 7 THEN '' ELSE 'steps_count' END AS m1,
 CASE WHEN o_orderkey % 11 >= 7 AND o_orderkey % 4 = 0 THEN 'blood_pressure' END AS m2
 FROM orders JOIN v_group_members m ON m.user_id = o_custkey"""

JUDGED = """SELECT c.*, CASE WHEN c.m1 NOT IN ('', 'heart_rate', 'spo2', 'weight', 'steps_count') THEN 'invalid_metric' WHEN c.op = 'disable' THEN 'ok' WHEN c.op = 'enable' AND c.viewer_id IS NOT NULL THEN 'use_list'
 WHEN NOT EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = c.group_id AND m.user_id = c.user_id AND (m.status = 'accepted' OR (c.viewer_id IS NULL AND m.status = 'pending_owner_approval'))) THEN 'not_member'
 ELSE 'ok' END AS v1 FROM changes c"""

FLAGS = """SELECT group_id, user_id, metric_type, -1 AS seq, TRUE AS present FROM v_sharing_permissions WHERE shared_with_user_id IS NULL
 UNION ALL SELECT j.group_id, j.user_id, t.name, j.seq, CASE WHEN j.op = 'set' THEN t.name = j.m1 OR (j.m2 IS NOT NULL AND t.name = j.m2) ELSE j.op = 'enable' END
 FROM judged j JOIN v_metric_types t ON j.op = 'set' OR t.name = j.m1 WHERE j.v1 = 'ok' AND j.viewer_id IS NULL"""

WANTED = """SELECT seq, group_id, user_id, viewer_id, UNNEST([m1, m2]) AS metric_type FROM judged WHERE v1 = 'ok' AND op = 'set' AND viewer_id IS NOT NULL"""

INBASE = """SELECT w.seq, BOOL_AND(COALESCE((SELECT ARG_MAX(f.present, f.seq) FROM flags f WHERE f.group_id = w.group_id AND f.user_id = w.user_id AND f.metric_type = w.metric_type AND f.seq < w.seq), FALSE)) AS within
 FROM wanted w WHERE w.metric_type <> '' GROUP BY w.seq"""

LISTS = """SELECT l.*, COALESCE(b.within, TRUE) AS within FROM judged l LEFT JOIN inbase b ON b.seq = l.seq WHERE l.v1 = 'ok' AND l.op = 'set' AND l.viewer_id IS NOT NULL
 QUALIFY ROW_NUMBER() OVER (PARTITION BY l.group_id, l.user_id, l.viewer_id ORDER BY l.seq DESC) = 1"""

AFTER = """SELECT group_id, user_id, metric_type, CAST(NULL AS BIGINT) AS shared_with_user_id FROM flags GROUP BY group_id, user_id, metric_type HAVING ARG_MAX(present, seq)
UNION ALL SELECT group_id, user_id, metric_type, viewer_id FROM
 (SELECT p.group_id, p.user_id, p.metric_type, p.shared_with_user_id AS viewer_id, -1 AS seq FROM v_sharing_permissions p WHERE p.shared_with_user_id IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM lists l WHERE l.group_id = p.group_id AND l.user_id = p.user_id AND l.viewer_id = p.shared_with_user_id)
  UNION ALL SELECT l.group_id, l.user_id, u.m, l.viewer_id, l.seq FROM lists l, UNNEST([l.m1, l.m2, 'access_control']) u(m) WHERE l.within AND COALESCE(l.m1, '') || COALESCE(l.m2, '') <> '' AND u.m <> '') x
 WHERE NOT EXISTS (SELECT 1 FROM judged d WHERE d.v1 = 'ok' AND d.op = 'disable' AND d.group_id = x.group_id AND d.user_id = x.user_id AND d.viewer_id = x.viewer_id AND d.m1 = x.metric_type AND d.seq > x.seq)"""

CHANGE_STEPS = [
    ("changes", PERMISSION_CHANGES), ("judged", JUDGED), ("flags", FLAGS), ("wanted", WANTED), ("inbase", INBASE), ("lists", LISTS),
]


def permission_changes(ds):
    rows = ds.sql(PERMISSION_CHANGES, ["v_group_members"])
    listed = rows.withColumn("metrics", F.filter(F.array("m1", "m2"), lambda m: m.isNotNull() & (m != ""))).drop("m1", "m2")
    return changes.apply_permission_changes(
        ds.view("v_sharing_permissions"), ds.view("v_group_members"), ds.view("v_metric_types"), listed
    )


@query("apply_permission_changes", AFTER, [*VIEWS, "v_sharing_permissions"], CHANGE_STEPS)
def apply_permission_changes(ds):
    return permission_changes(ds)[0]


@query(
    "permission_change_verdicts",
    "SELECT j.seq, CASE WHEN b.within = FALSE THEN 'not_in_base' ELSE j.v1 END AS verdict FROM judged j LEFT JOIN inbase b ON b.seq = j.seq",
    [*VIEWS, "v_sharing_permissions"],
    CHANGE_STEPS,
)
def permission_change_verdicts(ds):
    return permission_changes(ds)[1]


REMOVALS = """SELECT m.user_id * 100 + m.group_id AS seq, CASE WHEN user_id % 4 = 0 THEN 'leave' ELSE 'kick' END AS kind, group_id, user_id,
 CASE WHEN user_id % 5 = 0 THEN user_id ELSE o.owner_id END AS requester_id FROM v_group_members m JOIN v_groups o ON o.id = m.group_id
 UNION ALL SELECT -id - 1, 'group', id, CAST(NULL AS BIGINT), owner_id FROM v_groups UNION ALL SELECT -id - 1000, 'kick', id, 999999999, owner_id FROM v_groups"""

REMOVAL_VERDICTS = """SELECT d.seq, d.kind, d.group_id, d.user_id, CASE WHEN g.id IS NULL THEN 'invalid_group' WHEN d.kind IN ('kick', 'group') AND d.requester_id <> g.owner_id THEN 'not_owner'
 WHEN d.kind = 'kick' AND d.user_id = d.requester_id THEN 'owner_cannot_be_kicked' WHEN d.kind = 'leave' AND d.user_id = g.owner_id THEN 'owner_cannot_leave'
 WHEN d.kind = 'group' THEN CASE WHEN (SELECT COUNT(*) FROM v_group_members m WHERE m.group_id = d.group_id) > 1 THEN 'not_empty' ELSE 'deleted' END
 WHEN EXISTS (SELECT 1 FROM kept p WHERE p.group_id = d.group_id AND p.shared_with_user_id = d.user_id AND p.user_id <> d.user_id) THEN 'blocked_fk'
 WHEN NOT EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = d.group_id AND m.user_id = d.user_id) THEN 'member_not_found' ELSE 'deleted' END AS verdict
FROM removals d LEFT JOIN v_groups g ON g.id = d.group_id"""


# Viewer rows name every third user only, so that some members can be removed.
KEPT_PERMISSIONS = "SELECT * FROM v_sharing_permissions WHERE shared_with_user_id IS NULL OR shared_with_user_id % 3 = 0"


def removed(ds):
    return changes.cascade_delete(
        ds.view("v_groups"), ds.view("v_group_members"), ds.sql(KEPT_PERMISSIONS, ["v_sharing_permissions"]),
        ds.sql(REMOVALS, ["v_group_members", "v_groups"]),
    )


@query(
    "cascade_delete",
    """SELECT m.group_id, m.user_id, COUNT(p.metric_type) AS rows_left FROM v_group_members m LEFT JOIN kept p ON p.group_id = m.group_id AND p.user_id = m.user_id
 WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.verdict = 'deleted' AND j.group_id = m.group_id AND (j.kind = 'group' OR j.user_id = m.user_id)) GROUP BY m.group_id, m.user_id""",
    [*VIEWS, "v_sharing_permissions"],
    [("kept", KEPT_PERMISSIONS), ("removals", REMOVALS), ("judged", REMOVAL_VERDICTS)],
)
def cascade_delete(ds):
    tables, _ = removed(ds)
    left = tables["permissions"].groupBy("group_id", "user_id").agg(F.count(F.lit(1)).alias("rows_left"))
    return (
        tables["members"].select("group_id", "user_id").join(left, ["group_id", "user_id"], "left")
        .withColumn("rows_left", F.coalesce("rows_left", F.lit(0)))
    )


@query(
    "cascade_delete_verdicts",
    "SELECT seq, verdict FROM judged",
    [*VIEWS, "v_sharing_permissions"],
    [("kept", KEPT_PERMISSIONS), ("removals", REMOVALS), ("judged", REMOVAL_VERDICTS)],
)
def cascade_delete_verdicts(ds):
    return removed(ds)[1]


TRANSFERS = """SELECT user_id * 100 + group_id AS seq, group_id, CASE WHEN user_id % 3 = 0 THEN user_id ELSE o.owner_id END AS requester_id,
 CASE WHEN user_id % 7 = 0 THEN user_id + 900000000 ELSE user_id END AS new_owner_id FROM v_group_members m JOIN v_groups o ON o.id = m.group_id"""

TRANSFER_JUDGED = """SELECT t.*, g.owner_id, CASE WHEN g.id IS NULL THEN 'invalid_group' WHEN g.owner_id <> t.requester_id THEN 'not_owner' WHEN NOT EXISTS (SELECT 1 FROM v_users u WHERE u.id = t.new_owner_id) THEN 'not_owner'
 WHEN t.new_owner_id = t.requester_id THEN 'unchanged' WHEN NOT EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = t.group_id AND m.user_id = t.new_owner_id AND m.status = 'accepted') THEN 'not_member'
 ELSE 'transferred' END AS v FROM transfers t LEFT JOIN v_groups g ON g.id = t.group_id"""


@query(
    "transfer_ownership",
    """SELECT g.id, COALESCE((SELECT ARG_MIN(j.new_owner_id, j.seq) FROM judged j WHERE j.group_id = g.id AND j.v = 'transferred'), g.owner_id) AS owner_id FROM v_groups g""",
    VIEWS,
    [("transfers", TRANSFERS), ("judged", TRANSFER_JUDGED)],
)
def transfer_ownership(ds):
    members = ds.view("v_group_members").withColumn("role", F.lit("member"))
    groups, _, _ = changes.transfer_ownership(
        ds.view("v_groups"), members, ds.view("v_users"), ds.sql(TRANSFERS, ["v_group_members", "v_groups"])
    )
    return groups.select("id", "owner_id")


GROUP_REQUESTS = """SELECT o_orderkey AS seq, o_orderkey + 1000 AS id, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 900000000 ELSE o_custkey END AS owner_id, CASE o_orderkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN 'team 1' ELSE 'team ' || CAST(o_orderkey % 37 AS VARCHAR(9)) END AS name,
 CAST(NULL AS VARCHAR(20)) AS description, o_orderdate AS at FROM orders"""


@query(
    "bulk_groups",
    """SELECT q.seq, CASE WHEN strlen(q.name) NOT BETWEEN 3 AND 100 THEN 'invalid_name' WHEN NOT EXISTS (SELECT 1 FROM v_users u WHERE u.id = q.owner_id) THEN 'not_owner'
 WHEN EXISTS (SELECT 1 FROM v_groups g WHERE g.owner_id = q.owner_id AND g.name = q.name) OR q.seq > MIN(q.seq) OVER (PARTITION BY q.owner_id, q.name) THEN 'already_exists' ELSE 'ok' END AS verdict FROM wishes q""",
    VIEWS,
    [("wishes", GROUP_REQUESTS)],
)
def bulk_groups(ds):
    _, _, verdicts = changes.bulk_groups(ds.view("v_groups"), ds.view("v_users"), as_instants(ds.sql(GROUP_REQUESTS)))
    return verdicts


GROUP_PATCHES = """SELECT o_orderkey AS seq, CAST(FLOOR(o_custkey / 60) AS BIGINT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN g.owner_id ELSE o_custkey END AS requester_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 2 THEN 'team ' || CAST(o_orderkey AS VARCHAR(12)) END AS name, CAST(NULL AS VARCHAR(20)) AS description FROM orders LEFT JOIN v_groups g ON g.id = CAST(FLOOR(o_custkey / 60) AS BIGINT)"""


@query(
    "patch_groups",
    """SELECT g.id, COALESCE((SELECT ARG_MAX(p.name, p.seq) FROM patches p WHERE p.id = g.id AND p.requester_id = g.owner_id AND strlen(p.name) BETWEEN 3 AND 100), g.name) AS name FROM v_groups g""",
    VIEWS,
    [("patches", GROUP_PATCHES)],
)
def patch_groups(ds):
    table, _ = changes.patch_groups(ds.view("v_groups"), ds.sql(GROUP_PATCHES, ["v_groups"]))
    return table.select("id", "name")


# Events make users walk through invitation, answer and approval, in every order.
MEMBER_EVENTS = """SELECT e.event_id AS seq, CAST(FLOOR(e.user_id / 60) AS BIGINT) AS group_id, e.user_id AS user_id, CASE WHEN e.event_id % 3 = 0 THEN e.user_id ELSE COALESCE(g.owner_id, 0) END AS actor_id,
 CASE e.event_type WHEN 'click' THEN 'invite' WHEN 'view' THEN 'respond' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'reject' ELSE 'respond' END AS action,
 CASE e.event_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'accepted' END AS status, e.ts FROM events e LEFT JOIN v_groups g ON g.id = CAST(FLOOR(e.user_id / 60) AS BIGINT)"""

# The status machine as a recursive walk over each membership's numbered events.
MEMBER_WALK = """WITH RECURSIVE {views}, ev AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_id, user_id ORDER BY seq) AS rn FROM
  (SELECT m.*, g.owner_id = m.actor_id AS by_owner, g.id IS NOT NULL AS found, CASE WHEN m.status = 'accepted' THEN 'pending_owner_approval' ELSE m.status END AS asked
   FROM member_events m LEFT JOIN v_groups g ON g.id = m.group_id)),
 walk AS (SELECT group_id, user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, 'none' AS before, 'none' AS after FROM ev WHERE rn = 1
  UNION ALL SELECT e.group_id, e.user_id, e.rn, e.seq, w.after, CASE WHEN e.action = 'invite' AND e.found AND w.after = 'none' THEN 'pending'
   WHEN e.action = 'respond' AND w.after = 'pending' AND e.asked IN ('pending_owner_approval', 'rejected') THEN e.asked
   WHEN e.action = 'approve' AND e.by_owner AND w.after = 'pending_owner_approval' THEN 'accepted'
   WHEN e.action = 'reject' AND e.by_owner AND w.after = 'pending_owner_approval' THEN 'rejected' ELSE w.after END
  FROM walk w JOIN ev e ON e.group_id = w.group_id AND e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT group_id, user_id, seq, before, after FROM walk WHERE rn > 0"""


def _walk_oracle() -> str:
    from vitalgrid.sources.views import render

    views = f"v_groups AS ({render('v_groups', 'duckdb')}), member_events AS ({MEMBER_EVENTS})"
    return MEMBER_WALK.replace("{views}", views)


@query("membership_state", _walk_oracle())
def membership_state(ds):
    events = ds.sql(MEMBER_EVENTS, ["v_groups"])
    return changes.membership_steps(events, ds.view("v_groups")).select("group_id", "user_id", "seq", "before", "after")


AUDIT_MEMBERS = "SELECT * FROM v_group_members UNION ALL SELECT * FROM v_group_members WHERE user_id % 10 = 0"


@query(
    "constraint_audit",
    """SELECT 'group_members' AS "table", 'primary_key' AS rule, group_id || '/' || user_id AS key, COUNT(*) AS n FROM members GROUP BY group_id, user_id HAVING COUNT(*) > 1
UNION ALL SELECT 'group_members', 'fk_invited_by', CAST(invited_by AS VARCHAR), COUNT(*) FROM members WHERE invited_by NOT IN (SELECT id FROM v_users) GROUP BY invited_by
UNION ALL SELECT 'metrics', 'integral_steps', metric_type || '/' || user_id || '/' || CASE WHEN time = date_trunc('second', time) THEN strftime(time, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(time, '%Y-%m-%d %H:%M:%S.%f'), '0') END, 1 FROM v_readings WHERE metric_type = 'steps_count' AND value <> FLOOR(value)
UNION ALL SELECT 'sharing_permissions', 'fk_viewer', group_id || '/' || shared_with_user_id, COUNT(*) FROM v_sharing_permissions p WHERE shared_with_user_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM v_group_members m WHERE m.group_id = p.group_id AND m.user_id = p.shared_with_user_id) GROUP BY group_id, shared_with_user_id""",
    [*VIEWS, "v_sharing_permissions", "v_readings"],
    [("members", AUDIT_MEMBERS)],
)
def constraint_audit(ds):
    return audit.constraint_audit(
        {
            "users": ds.view("v_users"), "groups": ds.view("v_groups"), "group_members": ds.sql(AUDIT_MEMBERS, ["v_group_members"]),
            "sharing_permissions": ds.view("v_sharing_permissions"), "metrics": ds.view("v_readings"),
            "thresholds": ds.view("v_thresholds"), "metric_types": ds.view("v_metric_types"), "medications": ds.view("v_medications"),
            "reminders": ds.view("v_reminders"), "tokens": ds.view("v_tokens"),
        }
    )
