"""Queries: messages in, thresholds, alerts."""

import uuid

from pyspark.sql import functions as F

from vitalgrid.operators import access, alerts
from vitalgrid.plans.registry import query
from vitalgrid.plans.sharing import RULE_STEPS, WATCHERS
from vitalgrid.session import checkpoint_dir, cut_lineage
from vitalgrid.sources import readings as source
from vitalgrid.sources.tables import as_instants

EFFECTIVE = """SELECT u.id AS user_id, t.id AS metric_id, t.name AS metric_name, COALESCE(th.min_value, t.default_min_value) AS min_value,
 COALESCE(th.max_value, t.default_max_value) AS max_value, COALESCE(th.is_enabled, TRUE) AS is_enabled,
 COALESCE(th.updated_at, t.created_at) AS updated_at
FROM v_users u CROSS JOIN v_metric_types t LEFT JOIN v_thresholds th ON th.user_id = u.id AND th.metric_id = t.id"""

BREACHES = """SELECT r.event_id, r.user_id, r.metric_type, r.value, r.time, CASE WHEN r.value < e.min_value THEN 'low' ELSE 'high' END AS level,
 CASE WHEN r.value < e.min_value THEN e.min_value ELSE e.max_value END AS threshold
FROM v_readings r JOIN effective e ON e.user_id = r.user_id AND e.metric_name = r.metric_type
WHERE e.is_enabled AND (r.value < e.min_value OR r.value > e.max_value)"""

ALERTS = """SELECT b.user_id AS recipient_id, b.event_id, 'Health Alert' AS title, b.level, CAST(NULL AS VARCHAR) AS group_name, b.threshold,
 'Health Alert: Your ' || b.metric_type || ' is ' || b.level || ' (' || printf('%.2f', b.value) || '). Threshold is ' || printf('%.2f', b.threshold) AS body,
 'health_alert' AS data_type, printf('%.2f', b.value) AS data_value
FROM breaches b
UNION ALL
SELECT w.watcher_id, b.event_id, 'Health Alert (Shared)', b.level, w.group_name, b.threshold,
 'Health Alert: ' || COALESCE(u.name, 'A user') || '''s ' || b.metric_type || ' in group ' || w.group_name || ' is ' || b.level || ' (' ||
 printf('%.2f', b.value) || '). Threshold is ' || printf('%.2f', b.threshold), 'health_alert_shared', printf('%.2f', b.value)
FROM breaches b JOIN watchers w ON w.owner_id = b.user_id AND w.metric_type = b.metric_type JOIN v_users u ON u.id = b.user_id"""

VIEWS = ["v_users", "v_metric_types", "v_thresholds", "v_readings", "v_sharing_permissions", "v_groups", "v_tokens"]
STEPS = [("effective", EFFECTIVE), ("breaches", BREACHES), *RULE_STEPS, ("watchers", WATCHERS), ("alerts", ALERTS)]


def effective(ds):
    return alerts.effective_thresholds(ds.view("v_users"), ds.view("v_metric_types"), ds.view("v_thresholds"))


def breaches(ds):
    rows = ds.view("v_readings")
    bounds = alerts.thresholds_for(
        rows.select("user_id", "metric_type"), ds.view("v_metric_types"), ds.view("v_thresholds")
    )
    return alerts.threshold_breaches(rows, bounds)


def messages(ds):
    found = breaches(ds)
    watchers = access.metric_watchers(
        found.select(F.col("user_id").alias("owner_id"), "metric_type"),
        ds.view("v_sharing_permissions"), ds.view("v_group_members"), ds.view("v_users"), ds.view("v_groups"),
    )
    return alerts.alert_fanout(found, watchers, ds.view("v_users"))


@query("effective_thresholds", EFFECTIVE, VIEWS)
def effective_thresholds(ds):
    return effective(ds)


@query("threshold_breaches", "SELECT * FROM breaches", VIEWS, STEPS[:2])
def threshold_breaches(ds):
    return breaches(ds)


@query("alert_fanout", "SELECT * FROM alerts", VIEWS, STEPS)
def alert_fanout(ds):
    return messages(ds).select(
        "recipient_id", "event_id", "title", "level", "group_name", "threshold", "body",
        F.col("data")["type"].alias("data_type"), F.col("data")["value"].alias("data_value"),
    )


@query(
    "device_messages",
    "SELECT a.recipient_id, a.event_id, a.title, a.group_name, t.token FROM alerts a JOIN v_tokens t ON t.user_id = a.recipient_id",
    VIEWS,
    STEPS,
)
def device_messages(ds):
    return alerts.device_messages(messages(ds), ds.view("v_tokens")).select(
        "recipient_id", "event_id", "title", "group_name", "token"
    )


CHANGES = """SELECT event_id AS seq, user_id, CAST(1 + event_id % 7 AS INT) AS metric_id, CASE WHEN event_id % 3 <> 0 THEN value END AS min_value,
 CASE WHEN event_id % 4 <> 0 THEN value * 2 END AS max_value, event_id % 5 <> 0 AS is_enabled, time AS updated_at FROM v_readings"""


@query(
    "apply_thresholds",
    """SELECT user_id, metric_id, min_value, max_value, is_enabled, updated_at FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, metric_id ORDER BY seq DESC) AS rn FROM
  (SELECT -1 AS seq, user_id, metric_id, min_value, max_value, is_enabled, updated_at FROM v_thresholds
   UNION ALL SELECT * FROM changes WHERE metric_id IN (SELECT id FROM v_metric_types))) WHERE rn = 1""",
    VIEWS,
    [("changes", CHANGES)],
)
def apply_thresholds(ds):
    table, _ = alerts.apply_thresholds(
        ds.view("v_thresholds"), ds.sql(CHANGES, ["v_readings"]), ds.view("v_metric_types")
    )
    return table


TOKEN_CHANGES = """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'save' END AS op, user_id,
 'tok' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(event_id % 4 AS VARCHAR(4)) AS token, 'web' AS platform FROM v_readings"""


@query(
    "apply_device_tokens",
    """SELECT user_id, token, platform FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, token ORDER BY seq DESC) AS rn FROM
 (SELECT -1 AS seq, 'save' AS op, user_id, token, platform FROM v_tokens UNION ALL SELECT * FROM changes)) WHERE rn = 1 AND op = 'save'""",
    VIEWS,
    [("changes", TOKEN_CHANGES)],
)
def apply_device_tokens(ds):
    return alerts.apply_device_tokens(ds.view("v_tokens"), ds.sql(TOKEN_CHANGES, ["v_readings"]))


# Every reading as a message; some with a broken form.
RAW = """SELECT event_id AS seq, CASE
 WHEN event_id % 23 = 0 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":'
 WHEN event_id % 29 = 0 THEN '[1,2]'
 WHEN event_id % 31 = 0 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"' || metric_type || '","value":"7","timestamp":"2024-01-02T03:04:05Z"}'
 WHEN event_id % 37 = 0 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"' || metric_type || '","value":7.5}'
 WHEN event_id % 41 = 0 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"' || metric_type || '","value":7.5,"timestamp":"2024-01-02 03:04:05"}'
 WHEN event_id % 43 = 0 THEN '{"user_id":"nobody","metric_type":"' || metric_type || '","value":7.5,"timestamp":"2024-01-02T03:04:05Z"}'
 WHEN event_id % 47 = 0 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"' || metric_type || '","timestamp":"2024-01-02T03:04:05Z"}'
 ELSE '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"' || metric_type || '","value":' || CAST(CAST(FLOOR(value * 100) AS BIGINT) AS VARCHAR(20)) || ',"timestamp":"2024-01-' ||
  CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END || CAST(event_id % 28 + 1 AS VARCHAR(4)) || 'T03:04:05+07:00"}' END AS message FROM v_readings"""

DECODED = """SELECT seq, CASE WHEN bad THEN '' ELSE user_id END AS user_id, CASE WHEN bad THEN '' ELSE metric_type END AS metric_type, value, time,
 COALESCE(reason, CASE WHEN metric_type NOT IN (SELECT name FROM v_metric_types) THEN 'unknown_metric'
  WHEN user_id NOT IN (SELECT CAST(id AS VARCHAR) FROM v_users) THEN 'unknown_user' WHEN stamp IS NULL THEN 'missing_timestamp' END) AS reason
FROM (SELECT seq, bad, COALESCE(j->>'$.user_id', '') AS user_id, COALESCE(j->>'$.metric_type', '') AS metric_type, j->>'$.timestamp' AS stamp,
 COALESCE(TRY_CAST(j->>'$.value' AS DOUBLE), 0) AS value,
 CASE WHEN j->>'$.timestamp' LIKE '%+07:00' THEN strptime(j->>'$.timestamp', '%Y-%m-%dT%H:%M:%S+07:00') - INTERVAL 7 HOUR
  WHEN j->>'$.timestamp' LIKE '%Z' THEN strptime(j->>'$.timestamp', '%Y-%m-%dT%H:%M:%SZ') END AS time,
 CASE WHEN bad THEN 'invalid_json' WHEN json_type(j, '$.value') = 'VARCHAR' THEN 'wrong_type'
  WHEN j->>'$.timestamp' NOT LIKE '%T%' THEN 'bad_timestamp' END AS reason
 FROM (SELECT seq, NOT json_valid(message) OR message LIKE '[%' AS bad, CASE WHEN json_valid(message) AND message NOT LIKE '[%' THEN CAST(message AS JSON) END AS j FROM raw))"""


def decoded(ds):
    return source.ingest_readings(ds.sql(RAW, ["v_readings"]), ds.view("v_metric_types"), ds.view("v_users")).drop(
        "message"
    )


@query("ingest_readings", DECODED, VIEWS, [("raw", RAW)])
def ingest_readings(ds):
    return decoded(ds)


@query(
    "store_readings",
    """SELECT user_id, metric_type, value, time FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric_type, user_id, time ORDER BY seq) AS rn
 FROM decoded d WHERE reason IS NULL) x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = x.user_id AND o.metric_type = x.metric_type AND o.time = x.time)""",
    VIEWS,
    [("raw", RAW), ("decoded", DECODED), ("old", "SELECT * FROM decoded WHERE reason IS NULL AND seq % 10 = 3")],
)
def store_readings(ds):
    """Readings stored in two writes and read back: those of the second write, in files of at most some 500 rows."""
    root = f"{checkpoint_dir(ds.spark).rstrip('/')}/readings-{uuid.uuid4().hex}"
    good = cut_lineage(source.good_rows(decoded(ds)))
    source.store_readings(source.new_readings(good.filter(F.col("seq") % 10 == 3)), f"{root}/batch_id=0", per_slice=500)
    stored = ds.spark.read.option("basePath", root).parquet(root)
    source.store_readings(source.new_readings(good, stored), f"{root}/batch_id=1", per_slice=500)
    back = ds.spark.read.option("basePath", root).parquet(root).filter(F.col("batch_id") == 1)
    return back.select("user_id", "metric_type", "value", "time")


@query(
    "publish_readings",
    """SELECT CAST(user_id AS VARCHAR) AS key, 'reading' AS kind, CAST(user_id AS VARCHAR) AS user_id, metric_type, value AS number, time FROM v_readings""",
    VIEWS,
)
def publish_readings(ds):
    """Published messages read back, so the JSON text itself need not match another engine's."""
    return read_published(source.publish_readings(ds.view("v_readings")))


def read_published(messages):
    back = source.decode_readings(messages.withColumnRenamed("value", "message"))
    return back.select(
        "key", F.coalesce("reason", F.lit("reading")).alias("kind"), "user_id", "metric_type",
        F.col("value").alias("number"), "time",
    )


MESSAGES = """SELECT event_id, event_id % 50 AS client_id, user_id AS viewer_id, time AS arrived_at, CASE event_id % 8
 WHEN 0 THEN '{bad json' WHEN 1 THEN '{"action":"subscribe","items":[{"target_user_id":"7","metric_type":"spo2"}]}'
 WHEN 2 THEN '{"action":"subscribe","items":[]}' WHEN 3 THEN '{"hello":1}'
 WHEN 4 THEN '{"user_id":"1","metric_type":"spo2","value":4,"timestamp":"2024-01-02T03:04:05Z"}'
 WHEN 5 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"spo2","value":4}'
 WHEN 6 THEN '{"user_id":"' || CAST(user_id AS VARCHAR(20)) || '","metric_type":"spo2","value":4,"timestamp":"yesterday"}'
 ELSE '{"action":"unsubscribe","items":[{"target_user_id":"","metric_type":"spo2"}]}' END AS message FROM v_readings"""


@query(
    "push_guard",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'invalid_json' WHEN 3 THEN 'unknown' WHEN 4 THEN 'metric' WHEN 5 THEN 'metric' WHEN 6 THEN 'metric' ELSE 'control' END AS kind,
 CASE event_id % 8 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'accepted' WHEN 2 THEN 'invalid_control' WHEN 3 THEN 'unknown_structure'
  WHEN 4 THEN CASE WHEN viewer_id = 1 THEN 'accepted' ELSE 'forbidden' END WHEN 5 THEN 'accepted' WHEN 6 THEN 'invalid_metric' ELSE 'invalid_control' END AS verdict,
 CASE event_id % 8 WHEN 4 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN 5 THEN arrived_at WHEN 6 THEN arrived_at END AS time FROM messages""",
    VIEWS,
    [("messages", MESSAGES)],
)
def push_guard(ds):
    frame = as_instants(ds.sql(MESSAGES, ["v_readings"]))
    return source.push_guard(frame).select("event_id", "kind", "verdict", "time")
