"""Queries: subscriptions, delivery, gateway."""

from pyspark.sql import functions as F

from vitalgrid.operators import access, fanout, gateway
from vitalgrid.plans.registry import query
from vitalgrid.plans.sharing import PAIRS, RULE_STEPS, STREAM_WATCHERS
from vitalgrid.sources.tables import as_instants

VIEWS = ["v_readings", "v_sharing_permissions", "v_users", "v_groups", "v_control_events", "v_requests"]

STATE = """SELECT client_id, target_user_id, metric_type, group_id, viewer_id, event_id AS seq FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, target_user_id, metric_type, group_id ORDER BY event_id DESC) AS rn
  FROM v_control_events WHERE action <> 'disconnect') e
 WHERE rn = 1 AND action = 'subscribe' AND NOT EXISTS (SELECT 1 FROM v_control_events d WHERE d.client_id = e.client_id AND d.action = 'disconnect' AND d.event_id > e.event_id)"""

INTERVALS = """SELECT client_id, target_user_id, metric_type, group_id, FIRST(viewer_id ORDER BY event_id) AS viewer_id, MIN(ts) AS from_ts, to_ts FROM
 (SELECT s.*, (SELECT MIN(x.ts) FROM v_control_events x WHERE x.client_id = s.client_id AND x.event_id > s.event_id AND (x.action = 'disconnect'
   OR (x.action = 'unsubscribe' AND x.target_user_id = s.target_user_id AND x.metric_type = s.metric_type AND x.group_id = s.group_id))) AS to_ts
  FROM v_control_events s WHERE s.action = 'subscribe') GROUP BY client_id, target_user_id, metric_type, group_id, to_ts"""

# Permission spans: each right of the rule holds from the owner's day of month on, every third one for ten days.
SPANS = """SELECT owner_id, metric_type, watcher_id, group_id,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(owner_id % 12 AS INT) * INTERVAL '1' DAY AS from_ts,
 CASE WHEN watcher_id % 3 = 0 THEN TIMESTAMP '2024-01-11 00:00:00' + CAST(owner_id % 12 AS INT) * INTERVAL '1' DAY END AS to_ts FROM watchers"""


def control(ds):
    return ds.view("v_control_events").withColumnRenamed("event_id", "seq")


def watchers(ds):
    pairs = ds.sql(PAIRS, ["v_readings"])
    return access.stream_watchers(pairs, ds.view("v_sharing_permissions"), ds.view("v_group_members"), ds.view("v_groups"))


@query("subscription_state", STATE, VIEWS)
def subscription_state(ds):
    return fanout.subscription_state(control(ds))


@query("subscription_intervals", INTERVALS, VIEWS)
def subscription_intervals(ds):
    return fanout.subscription_intervals(control(ds))


@query(
    "broadcast_fanout",
    """SELECT r.event_id, s.client_id, s.group_id, s.viewer_id, r.metric_type, r.user_id AS target_user_id, r.value
FROM v_readings r JOIN state s ON s.target_user_id = r.user_id AND s.metric_type = r.metric_type
WHERE EXISTS (SELECT 1 FROM watchers w WHERE w.owner_id = r.user_id AND w.metric_type = r.metric_type AND w.watcher_id = s.viewer_id
 AND (s.group_id = '' OR s.group_id = CAST(w.group_id AS VARCHAR)))""",
    VIEWS,
    [*RULE_STEPS, ("watchers", STREAM_WATCHERS), ("state", STATE)],
)
def broadcast_fanout(ds):
    out = fanout.broadcast_fanout(ds.view("v_readings"), fanout.subscription_state(control(ds)), watchers(ds))
    return out.select("event_id", "client_id", "group_id", "viewer_id", "metric_type", "target_user_id", "value")


@query(
    "broadcast_as_of",
    """SELECT r.event_id, r.user_id AS target_user_id, r.metric_type, s.client_id, s.viewer_id, s.group_id
FROM v_readings r JOIN intervals s ON s.target_user_id = r.user_id AND s.metric_type = r.metric_type AND s.from_ts <= r.time AND (s.to_ts IS NULL OR r.time < s.to_ts)
WHERE EXISTS (SELECT 1 FROM spans w WHERE w.owner_id = r.user_id AND w.metric_type = r.metric_type AND w.watcher_id = s.viewer_id
 AND (s.group_id = '' OR s.group_id = CAST(w.group_id AS VARCHAR)) AND w.from_ts <= r.time AND (w.to_ts IS NULL OR r.time < w.to_ts))""",
    VIEWS,
    [*RULE_STEPS, ("watchers", STREAM_WATCHERS), ("intervals", INTERVALS), ("spans", SPANS)],
)
def broadcast_as_of(ds):
    rights = watchers(ds)
    start = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(owner_id % 12 as int))")
    spans = rights.withColumn("from_ts", start).withColumn(
        "to_ts", F.when(F.col("watcher_id") % 3 == 0, F.col("from_ts") + F.expr("interval 10 days"))
    )
    return fanout.broadcast_as_of(ds.view("v_readings"), fanout.subscription_intervals(control(ds)), spans, "event_id")


@query(
    "request_stats",
    "SELECT method, CASE WHEN path = '' THEN 'unknown' ELSE path END AS path, status, COUNT(*) AS n, ROUND(SUM(seconds), 6) AS sum_seconds, "
    + ", ".join(
        f"COUNT(*) FILTER (WHERE seconds <= {b}) AS le_{str(b).replace('.', '_').removesuffix('_0')}"
        for b in gateway.LATENCY_BOUNDS
    )
    + ", COUNT(*) AS le_inf FROM v_requests GROUP BY ALL",
    VIEWS,
)
def request_stats(ds):
    return gateway.request_stats(ds.view("v_requests")).withColumn("sum_seconds", F.round("sum_seconds", 6))


# The events lie minutes apart; here a quota of 3 per 2 hours makes windows overlap and fill.
LIMIT, SECONDS = 3, 7200

RATE = f"""WITH RECURSIVE {{views}},
 keyed AS (SELECT event_id, CASE WHEN sub IS NOT NULL THEN 'user:' || sub WHEN COALESCE(api_key, '') <> '' THEN 'apikey:' || api_key ELSE 'ip:' || ip END AS key,
  epoch_us(ts) AS t FROM v_requests),
 hops AS (SELECT k.key, k.t, MIN(n.t) AS nxt FROM keyed k LEFT JOIN keyed n ON k.key = n.key AND k.t + {SECONDS * 1000000} <= n.t GROUP BY k.key, k.t),
 opened AS (SELECT key, MIN(t) AS o FROM keyed GROUP BY key UNION SELECT h.key, h.nxt FROM opened p JOIN hops h ON h.key = p.key AND h.t = p.o WHERE h.nxt IS NOT NULL),
 placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key, o ORDER BY t, event_id) AS n FROM
  (SELECT k.event_id, k.key, k.t, MAX(p.o) AS o FROM keyed k JOIN opened p ON k.key = p.key AND k.t >= p.o GROUP BY k.event_id, k.key, k.t))
SELECT event_id, key, n, GREATEST({LIMIT} - n, 0) AS remaining, n > {LIMIT} AS blocked,
 CASE WHEN n > {LIMIT} THEN CAST(FLOOR((o + {SECONDS * 1000000} - t + 500000) / 1000000) AS BIGINT) END AS retry_after FROM placed"""


def _rate_oracle() -> str:
    from vitalgrid.sources.views import render

    return RATE.replace("{views}", f"v_requests AS ({render('v_requests', 'duckdb')})")


@query("rate_limit", _rate_oracle())
def rate_limit(ds):
    return gateway.rate_limit(ds.view("v_requests"), LIMIT, SECONDS)
