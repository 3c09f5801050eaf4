"""Health-domain views over the base tables, one SQL text for Spark and for the checking engine.

Groups hold about 80 members and grow in number with the customers, so the
pairs of members grow in proportion to the data. Each view names the views it builds on; ``with_views`` renders the needed ones
as a WITH list, so a query over views is a single statement in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.sources.tables import BASE_TABLES, load_table

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


view("v_metric_types", [], """
SELECT id, name, agg, default_min_value, default_max_value, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM (VALUES
 (1,'heart_rate','AVG',CAST(50 AS DOUBLE),CAST(120 AS DOUBLE)),
 (2,'steps_count','SUM',CAST(NULL AS DOUBLE),CAST(NULL AS DOUBLE)),
 (3,'calories_burned','SUM',CAST(NULL AS DOUBLE),CAST(NULL AS DOUBLE)),
 (4,'spo2','AVG',CAST(95 AS DOUBLE),CAST(NULL AS DOUBLE)),
 (5,'blood_pressure','AVG',CAST(NULL AS DOUBLE),CAST(140 AS DOUBLE)),
 (6,'weight','AVG',CAST(NULL AS DOUBLE),CAST(NULL AS DOUBLE)))
 AS t(id,name,agg,default_min_value,default_max_value)""")

view("v_users", [], """
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS name,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' END AS email,
 CASE WHEN c_custkey % 5 = 0 THEN 'verified' ELSE 'active' END AS status,
 CASE WHEN c_custkey % 4 = 0 THEN 'UTC' WHEN c_custkey % 4 = 1 THEN 'Asia/Ho_Chi_Minh' WHEN c_custkey % 4 = 2 THEN 'America/Bogota' ELSE 'Asia/Kolkata' END AS timezone,
 CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN 420 WHEN c_custkey % 4 = 2 THEN -300 ELSE 330 END AS tz_minutes,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey % 400 AS INT) * INTERVAL '1' HOUR AS created_at
 FROM customer""")

view("v_groups", [], """
SELECT CAST(FLOOR(c_custkey / 60) AS BIGINT) AS id, 'team ' || CAST(CAST(FLOOR(c_custkey / 60) AS BIGINT) AS VARCHAR(12)) AS name,
 MIN(c_custkey) AS owner_id, TIMESTAMP '2024-01-01 00:00:00' + CAST(MIN(c_custkey) % 7 AS INT) * INTERVAL '1' DAY AS created_at
 FROM customer GROUP BY CAST(FLOOR(c_custkey / 60) AS BIGINT)""")

view("v_group_members", [], """
SELECT CAST(FLOOR(c_custkey / 60) AS BIGINT) AS group_id, c_custkey AS user_id,
 CASE c_mktsegment WHEN 'FURNITURE' THEN 'pending' WHEN 'HOUSEHOLD' THEN 'pending_owner_approval' ELSE 'accepted' END AS status,
 c_custkey - c_custkey % 60 + 1 + c_custkey % 5 AS invited_by, TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey % 300 AS INT) * INTERVAL '1' HOUR AS created_at
 FROM customer
 UNION ALL
 SELECT CAST(FLOOR(c_custkey / 60) AS BIGINT) - 1 AS group_id, c_custkey AS user_id, 'accepted' AS status, c_custkey - c_custkey % 60 + 1 AS invited_by,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey % 300 AS INT) * INTERVAL '1' HOUR AS created_at
 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey >= 60""")

view("v_sharing_permissions", ["v_metric_types", "v_group_members"], """
SELECT m.group_id, m.user_id, t.name AS metric_type, CAST(NULL AS BIGINT) AS shared_with_user_id
 FROM v_group_members m JOIN v_metric_types t ON (m.user_id + t.id) % 3 <> 0 WHERE m.status <> 'pending'
 UNION ALL
 SELECT a.group_id, a.user_id, 'access_control' AS metric_type, b.user_id AS shared_with_user_id
 FROM v_group_members a JOIN v_group_members b ON a.group_id = b.group_id AND a.user_id <> b.user_id
 WHERE (a.user_id + b.user_id) % 5 = 0
 UNION ALL
 SELECT a.group_id, a.user_id, t.name AS metric_type, b.user_id AS shared_with_user_id
 FROM v_group_members a JOIN v_group_members b ON a.group_id = b.group_id AND a.user_id <> b.user_id
 JOIN v_metric_types t ON (a.user_id + b.user_id + t.id) % 4 = 0
 WHERE (a.user_id + b.user_id) % 5 <= 1""")

view("v_readings", [], """
SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'spo2'
 WHEN 'purchase' THEN 'calories_burned' WHEN 'signup' THEN 'steps_count' ELSE 'unknown_metric' END AS metric_type,
 value, ts AS time FROM events""")

view("v_thresholds", [], """
SELECT c_custkey AS user_id, CAST(1 + c_custkey % 6 AS INT) AS metric_id,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(5 AS DOUBLE) END AS min_value, CASE WHEN c_custkey % 3 = 0 THEN CAST(40 AS DOUBLE) END AS max_value,
 c_custkey % 10 <> 0 AS is_enabled, TIMESTAMP '2024-01-15 00:00:00' AS updated_at
 FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")

view("v_medications", [], """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS name, o_orderstatus <> 'F' AS is_active,
 CAST(o_orderdate AS DATE) AS start_date,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 900 ELSE NULL END AS end_date, o_orderdate AS created_at FROM orders""")

view("v_reminders", [], """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS medication_id, l_linenumber AS line_no, MIN(l_suppkey) AS k,
 CASE l_linenumber % 4 WHEN 0 THEN '08:00' WHEN 1 THEN '12:00' WHEN 2 THEN '16:30' ELSE '20:00' END AS time,
 MIN(l_returnflag) <> 'R' AS is_enabled, MAX(l_shipdate) AS last_taken FROM lineitem GROUP BY l_orderkey, l_linenumber""")

view("v_shares", [], """
SELECT o_orderkey AS id, o_orderkey AS medication_id, CAST(FLOOR(o_custkey / 60) AS BIGINT) AS group_id, o_custkey + 1 AS shared_with_user_id,
 CAST(15 * (o_orderkey % 5) AS INT) AS notify_offset_minutes,
 CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey * 10 + 1 END AS last_notified_reminder_id,
 CASE WHEN o_orderkey % 16 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS last_notified_date
 FROM orders WHERE o_orderkey % 4 = 0""")

view("v_requests", [], """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR(20)) END AS sub,
 CASE WHEN user_id % 3 = 1 THEN 'key' || CAST(user_id % 10 AS VARCHAR(20)) END AS api_key, 'ip' || CAST(user_id % 20 AS VARCHAR(20)) AS ip,
 'GET' AS method, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS path,
 CASE WHEN value > 100 THEN 500 ELSE 200 END AS status, value / 100 AS seconds, ts FROM events""")

view("v_control_events", [], """
SELECT event_id, user_id AS client_id, user_id AS viewer_id, user_id + event_id % 9 - 4 AS target_user_id,
 CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'spo2' ELSE 'steps_count' END AS metric_type,
 CASE WHEN event_id % 2 = 0 THEN '' ELSE CAST(CAST(FLOOR(user_id / 60) AS BIGINT) AS VARCHAR(20)) END AS group_id,
 CASE WHEN event_type = 'error' THEN 'unsubscribe' WHEN event_id % 500 = 0 THEN 'disconnect' ELSE 'subscribe' END AS action, ts FROM events""")

view("v_tokens", ["v_users"], """
SELECT u.id AS user_id, 'tok' || CAST(u.id AS VARCHAR(20)) || '-' || CAST(k.k AS VARCHAR(4)) AS token,
 CASE WHEN k.k = 1 THEN 'android' ELSE 'ios' END AS platform
 FROM v_users u JOIN (VALUES (1),(2)) AS k(k) ON k.k <= u.id % 3""")

view("rx_items", [], """
SELECT l_orderkey AS doc_id, l_linenumber AS no, MIN(l_partkey) AS partkey,
 CAST(MIN(l_quantity) AS INT) % 4 + 1 AS dose, MIN(l_suppkey) % 3 AS slot
 FROM lineitem GROUP BY l_orderkey, l_linenumber""")

view("rx_lines", ["rx_items"], """
SELECT doc_id, no, CAST(no AS VARCHAR(4)) || '. ' || p_name || ' ' || CAST(p_size * 10 AS VARCHAR(6)) || 'mg' || chr(10) ||
 CASE slot WHEN 0 THEN 'Sáng ' WHEN 1 THEN 'Trưa ' ELSE 'Tối ' END || CAST(dose AS VARCHAR(4)) || ' viên' AS line
 FROM rx_items JOIN part ON p_partkey = partkey""")

view("prescriptions", ["rx_lines"], """
SELECT doc_id, {concat_lines} AS text FROM rx_lines GROUP BY doc_id""")

DIALECT = {
    "spark": {"concat_lines": "listagg(line, chr(10)) WITHIN GROUP (ORDER BY no)"},
    "duckdb": {"concat_lines": "string_agg(line, chr(10) ORDER BY no)"},
}


def with_views(names: list[str], dialect: str, extra: list[tuple[str, str]] = ()) -> str:
    """WITH list holding the named views, what they build on, and extra (name, sql) steps."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [(n, render(n, dialect)) for n in ordered] + list(extra)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in parts) if parts else ""


def render(name: str, dialect: str) -> str:
    sql = VIEWS[name][1]
    for key, text in DIALECT[dialect].items():
        sql = sql.replace("{" + key + "}", text)
    return sql


class Dataset:
    """The base tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, f"{self.folder}/{name}.parquet")

    def sql(self, body: str, views: list[str] = (), extra: list[tuple[str, str]] = ()) -> DataFrame:
        """Run a statement over base tables and views; names resolve at once, so folders do not mix."""
        prefix = with_views(list(views), "spark", extra)
        text = f"{prefix}\n{body}"
        for name in BASE_TABLES:
            if name in text:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}", [name])
