"""Queries: medications and reminders."""

from pyspark.sql import functions as F

from vitalgrid.operators import meds
from vitalgrid.plans.registry import query
from vitalgrid.sources.tables import as_instants

VIEWS = ["v_users", "v_medications", "v_reminders", "v_shares", "v_readings"]

# An afternoon of ticks; the medications of the base data run from 1992 on.
START, END = "1996-03-05 01:00:00", "1996-03-05 14:00:00"
NOW = "1996-03-05 13:20:00"

DUE = f"""SELECT k.tick, r.id AS reminder_id, r.medication_id, m.user_id, r.time
FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MINUTE) k(tick)
JOIN v_users u ON TRUE JOIN v_medications m ON m.user_id = u.id JOIN v_reminders r ON r.medication_id = m.id
WHERE m.is_active AND r.is_enabled AND r.time = strftime(k.tick + u.tz_minutes * INTERVAL 1 MINUTE, '%H:%M')
 AND CAST(k.tick + u.tz_minutes * INTERVAL 1 MINUTE AS DATE) >= m.start_date
 AND (m.end_date IS NULL OR CAST(k.tick + u.tz_minutes * INTERVAL 1 MINUTE AS DATE) <= m.end_date)"""

MISSED = f"""SELECT share_id, medication_id, medication_name, reminder_id, reminder_time, owner_id, shared_with_user_id, notify_offset_minutes, zone, today FROM
 (SELECT s.id AS share_id, m.id AS medication_id, m.name AS medication_name, r.id AS reminder_id, r.time AS reminder_time, m.user_id AS owner_id,
   s.shared_with_user_id, s.notify_offset_minutes, u.timezone AS zone, CAST(TIMESTAMP '{NOW}' + u.tz_minutes * INTERVAL 1 MINUTE AS DATE) AS today,
   u.tz_minutes, r.last_taken, m.start_date, m.end_date, s.last_notified_reminder_id AS lr, s.last_notified_date AS ld
  FROM v_shares s JOIN v_medications m ON m.id = s.medication_id JOIN v_users u ON u.id = m.user_id JOIN v_reminders r ON r.medication_id = m.id
  WHERE m.is_active AND r.is_enabled)
WHERE (lr IS NULL OR lr <> reminder_id OR ld <> today) AND TIMESTAMP '{NOW}' >= CAST(start_date AS TIMESTAMP)
 AND (end_date IS NULL OR TIMESTAMP '{NOW}' <= CAST(end_date + 1 AS TIMESTAMP))
 AND (last_taken IS NULL OR CAST(last_taken + tz_minutes * INTERVAL 1 MINUTE AS DATE) <> today)
 AND TIMESTAMP '{NOW}' + tz_minutes * INTERVAL 1 MINUTE > CAST(CAST(today AS VARCHAR) || ' ' || reminder_time || ':00' AS TIMESTAMP) + notify_offset_minutes * INTERVAL 1 MINUTE"""


def tables(ds, *names):
    return [ds.view(f"v_{n}") for n in names]


def due(ds):
    reminders, medications, users = tables(ds, "reminders", "medications", "users")
    return meds.due_reminders(reminders, medications, users, meds.reminder_ticks(ds.spark, START, END))


def missed(ds):
    return meds.missed_reminders(*tables(ds, "shares", "medications", "reminders", "users"), NOW)


@query(
    "reminder_ticks",
    f"""SELECT k.tick, COUNT(*) AS reminders FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MINUTE) k(tick)
 JOIN v_reminders r ON r.time = strftime(k.tick, '%H:%M') GROUP BY k.tick""",
    VIEWS,
)
def reminder_ticks(ds):
    """Ticks with the reminders set for that minute in UTC."""
    ticks = meds.reminder_ticks(ds.spark, START, END).withColumn("time", F.date_format("tick", "HH:mm"))
    per_time = ds.view("v_reminders").groupBy("time").agg(F.count(F.lit(1)).alias("reminders"))
    return ticks.join(per_time, "time").select("tick", "reminders")


@query("due_reminders", DUE, VIEWS)
def due_reminders(ds):
    return due(ds)


@query("missed_reminders", MISSED, VIEWS)
def missed_reminders(ds):
    return missed(ds)


@query(
    "reminder_messages",
    f"""SELECT CASE k.k WHEN 0 THEN d.user_id WHEN 1 THEN m.owner_id ELSE m.shared_with_user_id END AS recipient_id,
 CASE k.k WHEN 0 THEN 'Medication Reminder' WHEN 1 THEN 'Missed Medication!' ELSE 'Medication Alert!' END AS title,
 CASE k.k WHEN 0 THEN 'It''s time for your medication.' WHEN 1 THEN 'You missed your medication: ' || m.medication_name || ' at ' || m.reminder_time || '. Please take it now.'
  ELSE 'Your buddy missed their medication: ' || m.medication_name || ' at ' || m.reminder_time || '.' END AS body,
 CASE k.k WHEN 0 THEN 'MEDICATION_REMINDER' WHEN 1 THEN 'MEDICATION_MISSED_OWNER' ELSE 'MEDICATION_MISSED_BUDDY' END AS kind,
 CAST(COALESCE(d.reminder_id, m.reminder_id) AS VARCHAR) AS reminder_id, CAST(CAST(epoch(d.tick) AS BIGINT) AS VARCHAR) AS stamp
FROM (VALUES (0), (1), (2)) k(k) LEFT JOIN due d ON k.k = 0 LEFT JOIN missed m ON k.k > 0 WHERE COALESCE(d.reminder_id, m.reminder_id) IS NOT NULL""",
    VIEWS,
    [("due", DUE), ("missed", MISSED)],
    inline=True,
)
def reminder_messages(ds):
    data = F.col("data")
    return meds.reminder_messages(due(ds), missed(ds)).select(
        "recipient_id", "title", "body", data["type"].alias("kind"), data["reminder_id"].alias("reminder_id"),
        data["timestamp"].alias("stamp"),
    )


@query(
    "missed_state",
    """SELECT s.id, s.medication_id, s.shared_with_user_id, COALESCE(k.reminder_id, s.last_notified_reminder_id) AS last_notified_reminder_id,
 COALESCE(k.today, s.last_notified_date) AS last_notified_date
FROM v_shares s LEFT JOIN (SELECT share_id, MAX(reminder_id) AS reminder_id, MAX(today) AS today FROM missed GROUP BY share_id) k ON k.share_id = s.id""",
    VIEWS,
    [("missed", MISSED)],
)
def missed_state(ds):
    return meds.missed_state(ds.view("v_shares"), missed(ds)).select(
        "id", "medication_id", "shared_with_user_id", "last_notified_reminder_id", "last_notified_date"
    )


# Clicks take the user's first reminder; some clicks come from somebody else.
TAKES = """SELECT f.medication_id, f.reminder_id, CASE WHEN e.event_id % 9 = 0 THEN e.user_id + 1 ELSE e.user_id END AS user_id, e.ts
FROM events e JOIN (SELECT m.user_id, MIN(r.id) AS reminder_id, MIN(r.medication_id) AS medication_id FROM v_medications m JOIN v_reminders r ON r.medication_id = m.id GROUP BY m.user_id) f
 ON f.user_id = e.user_id WHERE e.event_type = 'click'"""

TOGGLED = """SELECT r.id, r.medication_id, CASE WHEN f.reminder_id IS NULL THEN r.last_taken
 WHEN (f.n + CASE WHEN CAST(r.last_taken + f.tz_minutes * INTERVAL 1 MINUTE AS DATE) = f.day THEN 1 ELSE 0 END) % 2 = 1 THEN f.last END AS last_taken
FROM v_reminders r LEFT JOIN (SELECT reminder_id, tz_minutes, day, COUNT(*) AS n, MAX(ts) AS last FROM
  (SELECT t.*, u.tz_minutes, CAST(t.ts + u.tz_minutes * INTERVAL 1 MINUTE AS DATE) AS day,
    MAX(CAST(t.ts + u.tz_minutes * INTERVAL 1 MINUTE AS DATE)) OVER (PARTITION BY t.reminder_id) AS last_day
   FROM takes t JOIN v_medications m ON m.id = t.medication_id AND m.user_id = t.user_id JOIN v_users u ON u.id = t.user_id)
  WHERE day = last_day GROUP BY reminder_id, tz_minutes, day) f ON f.reminder_id = r.id"""


@query("toggle_takes", TOGGLED, VIEWS, [("takes", TAKES)])
def toggle_takes(ds):
    reminders, medications, users = tables(ds, "reminders", "medications", "users")
    takes = as_instants(ds.sql(TAKES, ["v_medications", "v_reminders"]))
    return meds.toggle_takes(reminders, medications, takes, users).select("id", "medication_id", "last_taken")


@query(
    "take_verdicts",
    """SELECT t.reminder_id, t.user_id, t.ts, CASE WHEN m.user_id <> t.user_id THEN 'forbidden' ELSE 'ok' END AS verdict
FROM takes t JOIN v_medications m ON m.id = t.medication_id""",
    VIEWS,
    [("takes", TAKES)],
)
def take_verdicts(ds):
    takes = as_instants(ds.sql(TAKES, ["v_medications", "v_reminders"]))
    out = meds.take_verdicts(takes, ds.view("v_medications"), ds.view("v_reminders"))
    return out.select("reminder_id", "user_id", "ts", "verdict")


SHARE_REQUESTS = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id, o_orderkey AS medication_id FROM orders"""


@query(
    "medication_shares_of",
    """SELECT q.request_id, q.medication_id, CASE WHEN m.id IS NULL THEN 'forbidden' ELSE 'ok' END AS verdict, s.id AS share_id, s.shared_with_user_id, s.notify_offset_minutes
FROM ask q LEFT JOIN v_medications m ON m.id = q.medication_id AND m.user_id = q.user_id LEFT JOIN v_shares s ON s.medication_id = m.id""",
    VIEWS,
    [("ask", SHARE_REQUESTS)],
)
def medication_shares_of(ds):
    return meds.medication_shares_of(ds.view("v_shares"), ds.view("v_medications"), ds.sql(SHARE_REQUESTS))


@query(
    "medications_nested",
    """SELECT m.id, m.user_id, m.name, u.timezone, COALESCE(r.reminders, '') AS reminders, COALESCE(s.shares, '') AS shares
FROM v_medications m JOIN v_users u ON u.id = m.user_id
LEFT JOIN (SELECT medication_id, STRING_AGG(time || '/' || id, ',' ORDER BY time, id) AS reminders FROM v_reminders GROUP BY medication_id) r ON r.medication_id = m.id
LEFT JOIN (SELECT medication_id, STRING_AGG(id || '/' || shared_with_user_id, ',' ORDER BY id) AS shares FROM v_shares GROUP BY medication_id) s ON s.medication_id = m.id""",
    VIEWS,
)
def medications_nested(ds):
    out = meds.medications_nested(*tables(ds, "medications", "reminders", "shares", "users"))
    text = lambda c, a, b: F.array_join(
        F.transform(c, lambda x: F.concat_ws("/", x[a].cast("string"), x[b].cast("string"))), ","
    )
    return out.select(
        "id", "user_id", "name", "timezone", text("reminders", "time", "reminder_id").alias("reminders"),
        text("shares", "share_id", "shared_with_user_id").alias("shares"),
    )


MED_ZONES = """SELECT id, user_id, created_at, CASE WHEN id % 3 = 0 THEN 'Europe/Paris' WHEN id % 3 = 1 THEN 'Asia/Tokyo' ELSE 'UTC' END AS timezone FROM v_medications"""


@query(
    "latest_timezone",
    """SELECT u.id, u.name, CASE WHEN n.user_id IS NULL THEN u.timezone ELSE n.timezone END AS timezone FROM v_users u LEFT JOIN
 (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM zoned) WHERE rn = 1) n ON n.user_id = u.id""",
    VIEWS,
    [("zoned", MED_ZONES)],
)
def latest_timezone(ds):
    return meds.latest_timezone(ds.sql(MED_ZONES, ["v_medications"]), ds.view("v_users")).select("id", "name", "timezone")


BODIES = """SELECT o_orderkey AS id, o_custkey AS user_id, '{"name":"' || o_orderpriority || '","dosage":"1","frequency":{"per":"day"},"start_date":"' ||
 CASE WHEN o_orderkey % 5 = 0 THEN '2024-02-30' WHEN o_orderkey % 5 = 1 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END || '"' ||
 CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN ',"reminders":[]' WHEN o_orderkey % 4 = 2 THEN ',"reminders":[{"time":""},{"time":"07:15","is_enabled":false}]'
  ELSE ',"is_active":false,"reminders":[{"time":"21:00"}],"shares":[{"group_id":3,"shared_with_user_id":4,"notify_offset_minutes":0}]' END || '}' AS body FROM orders"""


@query(
    "apply_medications",
    """SELECT b.id, b.user_id, b.is_active, b.start_date, r.pos, r.time, r.is_enabled, b.share_offset FROM
 (SELECT id, user_id, id % 4 <> 3 AS is_active, CASE WHEN id % 4 = 3 THEN 0 END AS share_offset,
   CASE WHEN id % 5 < 2 THEN DATE '2024-03-01' ELSE CAST(body->>'$.start_date' AS DATE) END AS start_date FROM bodies) b
 JOIN (VALUES (0, 0, '08:00', TRUE), (1, 0, '08:00', TRUE), (2, 0, '08:00', TRUE), (2, 1, '07:15', FALSE), (3, 0, '21:00', TRUE)) r(k, pos, time, is_enabled) ON r.k = b.id % 4""",
    VIEWS,
    [("bodies", BODIES)],
)
def apply_medications(ds):
    made = meds.apply_medications(ds.sql(BODIES), "2024-03-01")
    shares = made["shares"].select(F.col("medication_id").alias("id"), F.col("notify_offset_minutes").alias("share_offset"))
    return (
        made["medications"]
        .select("id", "user_id", "is_active", "start_date")
        .join(made["reminders"].withColumnRenamed("medication_id", "id"), "id")
        .join(shares, "id", "left")
    )


SHARE_CHANGES = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'add' END AS op,
 CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS medication_id,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS share_id, CAST(1 AS BIGINT) AS group_id, o_orderkey % 2 AS shared_with_user_id,
 CAST(o_orderkey % 4 - 1 AS INT) AS notify_offset_minutes FROM orders
 UNION ALL SELECT o_orderkey + 500000000, 'add', o_custkey, o_orderkey, o_orderkey + 2000000000, 1, o_orderkey % 2, 30 FROM orders"""


@query(
    "apply_shares",
    """SELECT q.seq, q.op, CASE WHEN q.op = 'delete' THEN CASE WHEN m.user_id IS NULL THEN 'not_found' WHEN m.user_id <> q.user_id THEN 'forbidden' WHEN s.id IS NULL THEN 'not_found' ELSE 'deleted' END
 ELSE CASE WHEN q.seq = MIN(q.seq) FILTER (WHERE q.op = 'add') OVER (PARTITION BY q.medication_id, q.shared_with_user_id)
  AND NOT EXISTS (SELECT 1 FROM v_shares k WHERE k.medication_id = q.medication_id AND k.shared_with_user_id = q.shared_with_user_id
   AND NOT EXISTS (SELECT 1 FROM changes d JOIN v_medications o ON o.id = d.medication_id AND o.user_id = d.user_id WHERE d.op = 'delete' AND d.share_id = k.id AND d.medication_id = k.medication_id))
  THEN 'added' ELSE 'already_shared' END END AS verdict
FROM changes q LEFT JOIN v_medications m ON m.id = q.medication_id LEFT JOIN v_shares s ON s.id = q.share_id AND s.medication_id = q.medication_id""",
    VIEWS,
    [("changes", SHARE_CHANGES)],
)
def apply_shares(ds):
    _, verdicts = meds.apply_shares(ds.view("v_shares"), ds.view("v_medications"), ds.sql(SHARE_CHANGES))
    return verdicts


DELETES = """SELECT o_orderkey AS medication_id, CASE WHEN o_orderkey % 8 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id FROM orders WHERE o_orderkey % 2 = 0"""


@query(
    "delete_medications",
    """SELECT r.id AS reminder_id, r.medication_id FROM v_reminders r WHERE NOT EXISTS
 (SELECT 1 FROM deletes d JOIN v_medications m ON m.id = d.medication_id AND m.user_id = d.user_id WHERE d.medication_id = r.medication_id)""",
    VIEWS,
    [("deletes", DELETES)],
)
def delete_medications(ds):
    left = meds.delete_medications(*tables(ds, "medications", "reminders", "shares"), ds.sql(DELETES))
    return left["reminders"].select(F.col("id").alias("reminder_id"), "medication_id")
