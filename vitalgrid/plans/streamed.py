"""Queries: the streaming jobs over files derived from the base tables, checked by the batch statements."""

from pyspark.sql import functions as F

from vitalgrid.operators import fanout
from vitalgrid.plans import alerts, live, medication
from vitalgrid.plans.registry import ORACLES, query
from vitalgrid.session import checkpoint_dir
from vitalgrid.streaming import streams


def _folder(ds) -> str:
    """A new folder per run below the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(ds.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _readings(ds, root):
    """Readings as a stream of files, written as the engine cuts them, two per batch."""
    rows = ds.view("v_readings")
    rows.write.parquet(f"{root}/in")
    return ds.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")


def _wait(stream):
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


TABLES = {
    "metric_types": "v_metric_types", "thresholds": "v_thresholds", "permissions": "v_sharing_permissions",
    "members": "v_group_members", "users": "v_users", "groups": "v_groups",
}


def _tables(ds):
    return {k: (lambda v=v: ds.view(v)) for k, v in TABLES.items()}


@query("stream_ingest", f"SELECT CAST(user_id AS VARCHAR) AS user_id, metric_type, value, time FROM ({alerts.DECODED}) d WHERE reason IS NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY metric_type, user_id, time ORDER BY seq) = 1", alerts.VIEWS, [("raw", alerts.RAW)])
def stream_ingest(ds):
    """Messages in two folders, the second filled after the first is read: the earlier one holds the earlier messages."""
    root = _folder(ds)
    raw = ds.sql(alerts.RAW, ["v_readings"])
    half = raw.agg(F.expr("percentile_approx(seq, 0.5)")).scalar()
    for part, keep in enumerate((F.col("seq") <= half, F.col("seq") > half)):
        raw.filter(keep).write.json(f"{root}/in/part={part}")
        stream = streams.message_stream(ds.spark, f"{root}/in/*")
        _wait(
            streams.stream_ingest(
                stream, f"{root}/store", f"{root}/bad", lambda: ds.view("v_metric_types"), lambda: ds.view("v_users"), f"{root}/ck"
            )
        )
    return streams.stored_readings(ds.spark, f"{root}/store").select("user_id", "metric_type", "value", "time")


@query("stream_alerts", ORACLES["alert_fanout"])
def stream_alerts(ds):
    root = _folder(ds)
    _wait(streams.stream_alerts(_readings(ds, root), _tables(ds), f"{root}/out", f"{root}/ck"))
    return ds.spark.read.parquet(f"{root}/out").select(
        "recipient_id", "event_id", "title", "level", "group_name", "threshold", "body",
        F.col("data")["type"].alias("data_type"), F.col("data")["value"].alias("data_value"),
    )


@query("stream_chart", ORACLES["chart_rollup"])
def stream_chart(ds):
    """Readings of six periods, one batch each: two levels of compaction with three batches a level."""
    root = _folder(ds)
    rows = ds.view("v_readings")
    rows.withColumn("period", F.col("event_id") % 6).write.partitionBy("period").parquet(f"{root}/in")
    for period in range(6):
        stream = ds.spark.readStream.schema(rows.schema).parquet(f"{root}/in/period=[0-{period}]")
        _wait(streams.stream_chart(stream, f"{root}/rollup", f"{root}/ck", fan=3))
    out = streams.read_chart(ds.spark, f"{root}/rollup", ds.view("v_metric_types"), fan=3)
    return out.withColumn("value", F.round("value", 6))


@query("stream_publish", ORACLES["publish_readings"])
def stream_publish(ds):
    """Messages published by a stream that is stopped after half of the readings and resumed, read back."""
    root = _folder(ds)
    rows = ds.view("v_readings")
    for part in range(2):
        rows.filter(F.col("event_id") % 2 == part).write.parquet(f"{root}/in/part={part}")
        stream = ds.spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")
        _wait(streams.stream_publish(stream, f"{root}/out", f"{root}/ck"))
    return alerts.read_published(ds.spark.read.parquet(f"{root}/out"))


@query("stream_broadcast", ORACLES["broadcast_fanout"])
def stream_broadcast(ds):
    root = _folder(ds)
    tables = {**_tables(ds), "subscriptions": lambda: fanout.subscription_state(live.control(ds))}
    _wait(streams.stream_broadcast(_readings(ds, root), tables, f"{root}/out", f"{root}/ck"))
    return ds.spark.read.parquet(f"{root}/out").select(
        "event_id", "client_id", "group_id", "viewer_id", "metric_type", "target_user_id", "value"
    )


# Ticks of two days; on the second one the marks of the first count no more.
TICKS = ["1996-03-05 09:20:00", "1996-03-05 13:20:00", "1996-03-05 13:21:00", "1996-03-06 13:20:00"]
SENT = ["share_id", "reminder_id", "today", "owner_id", "shared_with_user_id", "medication_name", "reminder_time"]


def _replay():
    """The ticks one after the other: what each finds under the marks so far, and the marks after it."""
    steps, shares = [], "v_shares"
    for i, tick in enumerate(TICKS):
        steps.append((f"missed_{i}", medication.MISSED.replace("v_shares", shares).replace(medication.NOW, tick)))
        steps.append((f"shares_{i}", f"""SELECT s.id, s.medication_id, s.shared_with_user_id, s.notify_offset_minutes, COALESCE(k.reminder_id, s.last_notified_reminder_id) AS last_notified_reminder_id,
 COALESCE(k.today, s.last_notified_date) AS last_notified_date FROM {shares} s LEFT JOIN (SELECT share_id, MAX(reminder_id) AS reminder_id, MAX(today) AS today FROM missed_{i} GROUP BY share_id) k ON k.share_id = s.id"""))
        shares = f"shares_{i}"
    return steps


@query(
    "stream_missed",
    " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS batch_id, {', '.join(SENT)} FROM missed_{i}" for i in range(len(TICKS))),
    medication.VIEWS,
    _replay(),
)
def stream_missed(ds):
    """Missed reminders of four ticks, one batch each; marks of a batch decide what the next ones send."""
    root = _folder(ds)
    tables = {k: (lambda v=f"v_{k}": ds.view(v)) for k in ("shares", "medications", "reminders", "users")}
    for i, tick in enumerate(TICKS):
        ds.spark.sql(f"SELECT TIMESTAMP '{tick}' AS tick").write.parquet(f"{root}/in/tick={i}")
        ticks = ds.spark.readStream.schema("tick timestamp").parquet(f"{root}/in/tick=[0-{i}]")
        _wait(streams.stream_missed(ticks, tables, f"{root}/marks", f"{root}/out", f"{root}/ck", fan=2))
    return ds.spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").select(F.col("batch_id").cast("bigint").alias("batch_id"), *SENT)
