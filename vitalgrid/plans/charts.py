"""Queries: charts and heart-rate windows."""

from pyspark.sql import functions as F

from vitalgrid.operators import series
from vitalgrid.plans.registry import query
from vitalgrid.plans.sharing import ASKED_OFFERS, GRANTED, RULE

# Own charts for four keywords, and the next user's heart rate and SpO2 over custom ranges.
REQUESTS = """
SELECT CAST(o.observer_id AS VARCHAR(20)) || '/' || CAST(o.user_id AS VARCHAR(20)) || '/' || o.metric_type || '/' || CAST(k.no AS VARCHAR(4)) AS request_id, o.observer_id, o.user_id, o.metric_type,
 k.range, k.s AS "start", k.e AS "end", TIMESTAMP '2024-01-31 00:00:00' AS now
FROM (SELECT DISTINCT user_id AS observer_id, user_id, metric_type FROM v_readings WHERE metric_type <> 'unknown_metric'
 UNION SELECT DISTINCT user_id + 25 AS observer_id, user_id, metric_type FROM v_readings WHERE metric_type IN ('heart_rate', 'spo2')) o
JOIN (VALUES (1, '24h', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)), (2, '7d', NULL, NULL), (3, '', NULL, NULL),
 (4, '30d', NULL, NULL), (5, 'custom', NULL, TIMESTAMP '2024-01-05 00:00:00'),
 (6, 'custom', TIMESTAMP '2024-01-10 06:30:00', TIMESTAMP '2024-01-12 06:30:00'),
 (7, 'custom', TIMESTAMP '2023-12-31 11:00:00', TIMESTAMP '2024-02-20 12:00:00'),
 (8, 'custom', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-10 00:00:00'),
 (9, 'custom', TIMESTAMP '2022-01-01 00:00:00', TIMESTAMP '2024-01-10 00:00:00')) k(no, range, s, e) ON o.user_id % 5 >= 0"""

PLAN_SQL = """
SELECT *, CASE WHEN range = '24h' THEN now - INTERVAL 1 DAY WHEN range = '30d' THEN now - INTERVAL 30 DAY
 WHEN range = 'custom' THEN "start" ELSE now - INTERVAL 7 DAY END AS start_time,
 CASE WHEN range = 'custom' THEN "end" ELSE now END AS end_time FROM requests"""

PLANNED = """
SELECT *, CASE WHEN range = 'custom' AND ("start" IS NULL OR "end" IS NULL) THEN NULL
 WHEN epoch(end_time - start_time) / 86400 <= 1 THEN '15 minutes' WHEN epoch(end_time - start_time) / 86400 <= 2 THEN '1 hour'
 WHEN epoch(end_time - start_time) / 86400 <= 30 THEN '1 day' WHEN epoch(end_time - start_time) / 86400 <= 365 THEN '1 week' END AS bucket,
 CASE WHEN range = 'custom' AND ("start" IS NULL OR "end" IS NULL) THEN 'missing_times'
 WHEN epoch(end_time - start_time) / 86400 > 365 THEN 'invalid_range' ELSE 'ok' END AS status FROM plan_times"""

STEPS = [("requests", REQUESTS), ("plan_times", PLAN_SQL), ("planned", PLANNED)]

# Distinct questions behind the requests; one's own data needs no grant.
ASKED = "SELECT DISTINCT observer_id, user_id AS target_id, metric_type FROM requests"
ALLOWED = """SELECT observer_id, target_id, metric_type FROM asked WHERE observer_id = target_id
 UNION SELECT viewer_id, owner_id, metric_type FROM granted"""
ACCESS_STEPS = [("asked", ASKED), *RULE, ("offers", ASKED_OFFERS), ("granted", GRANTED), ("allowed", ALLOWED)]


def requests(ds):
    from vitalgrid.sources.tables import as_instants

    return as_instants(ds.sql(REQUESTS.replace('"', "`"), ["v_readings"]))


@query(
    "chart_plan",
    'SELECT request_id, range, start_time, end_time, bucket, status FROM planned',
    ["v_readings"],
    STEPS,
)
def chart_plan(ds):
    return series.chart_plan(requests(ds)).select("request_id", "range", "start_time", "end_time", "bucket", "status")


@query(
    "chart_buckets",
    """SELECT p.request_id, p.user_id, p.metric_type, p.bucket,
 CASE p.bucket WHEN '15 minutes' THEN time_bucket(INTERVAL 15 MINUTE, r.time) WHEN '1 hour' THEN time_bucket(INTERVAL 1 HOUR, r.time)
 WHEN '1 day' THEN time_bucket(INTERVAL 1 DAY, r.time) ELSE time_bucket(INTERVAL 7 DAY, r.time) END AS bucket_time,
 ROUND(CASE WHEN t.agg = 'SUM' THEN SUM(r.value) ELSE AVG(r.value) END, 6) AS value
FROM planned p JOIN v_metric_types t ON t.name = p.metric_type
JOIN v_readings r ON r.user_id = p.user_id AND r.metric_type = p.metric_type AND r.time BETWEEN p.start_time AND p.end_time
JOIN allowed ON allowed.observer_id = p.observer_id AND allowed.target_id = p.user_id AND allowed.metric_type = p.metric_type
WHERE p.status = 'ok'
GROUP BY p.request_id, p.user_id, p.metric_type, p.bucket, bucket_time, t.agg""",
    ["v_readings", "v_metric_types", "v_sharing_permissions"],
    [*STEPS, *ACCESS_STEPS],
)
def chart_buckets(ds):
    out = series.chart_buckets(
        ds.view("v_readings"),
        ds.view("v_metric_types"),
        requests(ds),
        ds.view("v_sharing_permissions"),
        ds.view("v_group_members"),
    )
    return out.withColumn("value", F.round("value", 6))


@query(
    "chart_rollup",
    """SELECT r.user_id, r.metric_type, w.bucket,
 CASE w.bucket WHEN '15 minutes' THEN time_bucket(INTERVAL 15 MINUTE, r.time) WHEN '1 hour' THEN time_bucket(INTERVAL 1 HOUR, r.time)
 WHEN '1 day' THEN time_bucket(INTERVAL 1 DAY, r.time) ELSE time_bucket(INTERVAL 7 DAY, r.time) END AS bucket_time,
 ROUND(CASE WHEN t.agg = 'SUM' THEN SUM(r.value) ELSE AVG(r.value) END, 6) AS value
FROM v_readings r JOIN v_metric_types t ON t.name = r.metric_type
CROSS JOIN (VALUES ('15 minutes'), ('1 hour'), ('1 day'), ('1 week')) w(bucket)
GROUP BY r.user_id, r.metric_type, w.bucket, 4, t.agg""",
    ["v_readings", "v_metric_types"],
)
def chart_rollup(ds):
    out = series.read_rollup(series.rollup_deltas(ds.view("v_readings")), ds.view("v_metric_types"))
    return out.withColumn("value", F.round("value", 6))


@query(
    "hr_window_features",
    """SELECT user_id, time_bucket(INTERVAL 1 MINUTE, time) AS window_start, ROUND(AVG(value), 6) AS hr_mean,
 ROUND(STDDEV_POP(value), 6) AS hr_std FROM v_readings WHERE metric_type = 'heart_rate' GROUP BY user_id, window_start""",
    ["v_readings"],
)
def hr_window_features(ds):
    out = series.hr_window_features(ds.view("v_readings"))
    return out.withColumn("hr_mean", F.round("hr_mean", 6)).withColumn("hr_std", F.round("hr_std", 6))
