"""Queries: the sharing rule."""

from pyspark.sql import functions as F

from vitalgrid.operators import access
from vitalgrid.plans.registry import query

PAIRS = "SELECT DISTINCT user_id AS owner_id, metric_type FROM v_readings"

# Observers at fixed distances from every owner that has readings; distance 0 asks for one's own data.
ASKED = """SELECT r.user_id + d.d AS observer_id, r.user_id AS target_id, r.metric_type
 FROM (SELECT DISTINCT user_id, metric_type FROM v_readings) r JOIN (VALUES (0), (1), (25), (59), (75), (100)) d(d) ON d.d >= 0"""

# The rule as set operations. An offer is a sharer's global row brought to another accepted member of the group.
# Offers to viewers the sharer screens are taken out, those listed for the viewer are put back.
RULE = [
    ("in_group", "SELECT group_id, user_id FROM v_group_members WHERE status = 'accepted'"),
    ("offered", """SELECT p.group_id, p.user_id AS owner_id, p.metric_type FROM v_sharing_permissions p
 JOIN in_group USING (group_id, user_id) WHERE p.shared_with_user_id IS NULL"""),
    ("screened", """SELECT DISTINCT group_id, user_id AS owner_id, shared_with_user_id AS viewer_id FROM v_sharing_permissions
 WHERE metric_type = 'access_control' AND shared_with_user_id IS NOT NULL"""),
    ("listed", """SELECT group_id, user_id AS owner_id, shared_with_user_id AS viewer_id, metric_type FROM v_sharing_permissions
 WHERE shared_with_user_id IS NOT NULL"""),
]
GRANTED = """(SELECT group_id, owner_id, viewer_id, metric_type FROM offers
 EXCEPT SELECT group_id, owner_id, viewer_id, metric_type FROM offers JOIN screened USING (group_id, owner_id, viewer_id))
 UNION (SELECT group_id, owner_id, viewer_id, metric_type FROM offers JOIN screened USING (group_id, owner_id, viewer_id)
  INTERSECT SELECT group_id, owner_id, viewer_id, metric_type FROM listed)"""
OFFERS = """SELECT group_id, owner_id, m.user_id AS viewer_id, metric_type
 FROM offered JOIN pairs USING (owner_id, metric_type) JOIN in_group m USING (group_id) WHERE m.user_id <> owner_id"""
RULE_STEPS = [("pairs", PAIRS), *RULE, ("offers", OFFERS), ("granted", GRANTED)]

WATCHERS = """SELECT DISTINCT t.owner_id, t.metric_type, t.viewer_id AS watcher_id, u.name AS watcher_name, g.name AS group_name
FROM granted t JOIN v_users u ON u.id = t.viewer_id JOIN v_groups g ON g.id = t.group_id"""

STREAM_WATCHERS = """SELECT t.owner_id, t.metric_type, t.viewer_id AS watcher_id, t.group_id, g.name AS group_name
FROM granted t JOIN v_groups g ON g.id = t.group_id"""

ALL_VIEWS = ["v_readings", "v_sharing_permissions", "v_users", "v_groups"]


def pairs(ds):
    return ds.sql(PAIRS, ["v_readings"])


@query("metric_watchers", WATCHERS, ALL_VIEWS, RULE_STEPS)
def metric_watchers(ds):
    return access.metric_watchers(
        pairs(ds), ds.view("v_sharing_permissions"), ds.view("v_group_members"), ds.view("v_users"), ds.view("v_groups")
    )


@query("stream_watchers", STREAM_WATCHERS, ALL_VIEWS, RULE_STEPS)
def stream_watchers(ds):
    return access.stream_watchers(
        pairs(ds), ds.view("v_sharing_permissions"), ds.view("v_group_members"), ds.view("v_groups")
    )


# Offers to the observers asked about only.
ASKED_OFFERS = """SELECT group_id, owner_id, a.observer_id AS viewer_id, a.metric_type
 FROM asked a JOIN offered o ON o.owner_id = a.target_id AND o.metric_type = a.metric_type
 JOIN in_group m USING (group_id) WHERE m.user_id = a.observer_id AND a.observer_id <> a.target_id"""


@query(
    "check_access",
    """SELECT observer_id, target_id, metric_type, 'allowed' AS verdict FROM asked WHERE observer_id = target_id
UNION SELECT viewer_id, owner_id, metric_type, 'allowed' FROM granted
UNION (SELECT observer_id, target_id, metric_type, 'denied' FROM asked WHERE observer_id <> target_id
 EXCEPT SELECT viewer_id, owner_id, metric_type, 'denied' FROM granted)""",
    ["v_readings", "v_sharing_permissions"],
    [("asked", ASKED), *RULE, ("offers", ASKED_OFFERS), ("granted", GRANTED)],
)
def check_access(ds):
    return access.check_access(
        ds.sql(ASKED, ["v_readings"]), ds.view("v_sharing_permissions"), ds.view("v_group_members")
    )


VIEWERS = "SELECT group_id, user_id AS viewer_id FROM v_group_members"


@query(
    "visible_metrics",
    """SELECT v.group_id, v.viewer_id, sp.user_id AS member_id, STRING_AGG(sp.metric_type, ',' ORDER BY sp.metric_type) AS metrics
FROM viewers v JOIN v_sharing_permissions sp ON sp.group_id = v.group_id
 JOIN v_group_members gm ON gm.group_id = sp.group_id AND gm.user_id = sp.user_id AND gm.status = 'accepted'
 LEFT JOIN (SELECT DISTINCT group_id, user_id, shared_with_user_id FROM v_sharing_permissions WHERE metric_type = 'access_control') ac
  ON ac.group_id = v.group_id AND ac.user_id = sp.user_id AND ac.shared_with_user_id = v.viewer_id
WHERE sp.user_id <> v.viewer_id AND sp.metric_type <> 'access_control'
 AND ((ac.user_id IS NOT NULL AND sp.shared_with_user_id = v.viewer_id) OR (ac.user_id IS NULL AND sp.shared_with_user_id IS NULL))
GROUP BY v.group_id, v.viewer_id, sp.user_id""",
    ["v_sharing_permissions"],
    [("viewers", VIEWERS)],
)
def visible_metrics(ds):
    out = access.visible_metrics(
        ds.view("v_sharing_permissions"), ds.view("v_group_members"), ds.sql(VIEWERS, ["v_group_members"])
    )
    return out.withColumn("metrics", F.array_join("metrics", ","))


@query(
    "orphan_permissions",
    """SELECT sp.* FROM v_sharing_permissions sp LEFT JOIN (SELECT DISTINCT group_id, user_id, shared_with_user_id AS viewer_id, TRUE AS marked
  FROM v_sharing_permissions WHERE metric_type = 'access_control') ac
 ON ac.group_id = sp.group_id AND ac.user_id = sp.user_id AND ac.viewer_id = sp.shared_with_user_id
 WHERE sp.shared_with_user_id IS NOT NULL AND sp.metric_type <> 'access_control' AND ac.marked IS NULL""",
    ["v_sharing_permissions"],
)
def orphan_permissions(ds):
    return access.orphan_permissions(ds.view("v_sharing_permissions"))


PERMISSION_PAIRS = """SELECT group_id * 100000000 + user_id AS request_id, group_id, user_id,
 CASE WHEN user_id % 2 = 0 THEN user_id + 50 END AS viewer_id FROM v_group_members"""


@query(
    "permissions_for",
    """SELECT q.request_id, p.* FROM ask q JOIN v_sharing_permissions p ON p.group_id = q.group_id AND p.user_id = q.user_id
 WHERE q.viewer_id IS NULL OR p.shared_with_user_id = q.viewer_id OR p.shared_with_user_id IS NULL""",
    ["v_sharing_permissions"],
    [("ask", PERMISSION_PAIRS)],
)
def permissions_for(ds):
    return access.permissions_for(ds.view("v_sharing_permissions"), ds.sql(PERMISSION_PAIRS, ["v_group_members"]))


@query(
    "permission_summary",
    """SELECT k.group_id, k.user_id, COALESCE(g.global, '') AS global, COALESCE(s.specific, '') AS specific
FROM (SELECT DISTINCT group_id, user_id FROM v_sharing_permissions) k
LEFT JOIN (SELECT group_id, user_id, STRING_AGG(metric_type, ',' ORDER BY metric_type) AS global FROM v_sharing_permissions
 WHERE shared_with_user_id IS NULL AND metric_type <> 'access_control' GROUP BY ALL) g USING (group_id, user_id)
LEFT JOIN (SELECT group_id, user_id, STRING_AGG(v, ';' ORDER BY shared_with_user_id) AS specific FROM
 (SELECT group_id, user_id, shared_with_user_id, shared_with_user_id || ':' || STRING_AGG(metric_type, ',' ORDER BY metric_type) AS v
  FROM v_sharing_permissions WHERE shared_with_user_id IS NOT NULL AND metric_type <> 'access_control' GROUP BY group_id, user_id, shared_with_user_id)
 GROUP BY group_id, user_id) s USING (group_id, user_id)""",
    ["v_sharing_permissions"],
)
def permission_summary(ds):
    out = access.permission_summary(ds.view("v_sharing_permissions"))
    text = F.transform(
        "specific", lambda s: F.concat_ws(":", s["viewer_id"].cast("string"), F.array_join(s["metrics"], ","))
    )
    return out.select(
        "group_id", "user_id", F.array_join("global", ",").alias("global"), F.array_join(text, ";").alias("specific")
    )
