"""Live subscriptions and delivery of readings to authorised subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.asof import next_event
from vitalgrid.functions.intervals import in_force
from vitalgrid.session import cut_lineage

KEY = ["client_id", "target_user_id", "metric_type", "group_id"]
# Control events are numbered; buckets of this many keep the next-event windows short.
SEQ_BUCKET = 100_000


def subscription_state(events: DataFrame) -> DataFrame:
    """Live (client, target, metric, group) set after all control events.

    ``events``: seq, client_id, viewer_id, target_user_id, metric_type,
    group_id ('' = any group), action. The last event of a key decides, if it
    came after the client's last disconnect.
    """
    gone = (
        events.filter(F.col("action") == "disconnect").groupBy("client_id").agg(F.max("seq").alias("gone_seq"))
    )
    last = (
        events.filter(F.col("action").isin("subscribe", "unsubscribe"))
        .groupBy(*KEY)
        .agg(F.max_by(F.struct("action", "viewer_id", "seq"), "seq").alias("last"))
    )
    return (
        last.filter(F.col("last.action") == "subscribe")
        .join(gone, "client_id", "left")
        .filter(F.col("gone_seq").isNull() | (F.col("last.seq") > F.col("gone_seq")))
        .select(*KEY, F.col("last.viewer_id").alias("viewer_id"), F.col("last.seq").alias("seq"))
    )


def subscription_intervals(events: DataFrame) -> DataFrame:
    """[from_ts, to_ts) during which a subscription was live; open ones have a null end.

    A repeated subscribe inside a live interval starts no new one.
    """
    subs = events.filter(F.col("action") == "subscribe").select(*KEY, "viewer_id", "seq", "ts")
    unsubs = events.filter(F.col("action") == "unsubscribe")
    gone = events.filter(F.col("action") == "disconnect")
    ended = next_event(subs, unsubs, KEY, "seq", "unsub_seq", SEQ_BUCKET)
    ended = next_event(ended, gone, ["client_id"], "seq", "gone_seq", SEQ_BUCKET)
    ends = ended.withColumn("end_seq", F.least("unsub_seq", "gone_seq"))
    # repeats of one interval share their end, so the earliest of them opens it
    spans = ends.groupBy(*KEY, "end_seq").agg(F.min_by(F.struct("seq", "ts", "viewer_id"), "seq").alias("first"))
    closing = events.select(F.col("seq").alias("end_seq"), F.col("ts").alias("to_ts"))
    return spans.join(closing, "end_seq", "left").select(
        *KEY,
        F.col("first.viewer_id").alias("viewer_id"),
        F.col("first.ts").alias("from_ts"),
        "to_ts",
    )


def broadcast_fanout(readings: DataFrame, subscriptions: DataFrame, watchers: DataFrame) -> DataFrame:
    """One row per reading and live subscription whose viewer is authorised.

    ``watchers`` is the result of ``stream_watchers`` for the readings' pairs.
    A subscription without a group needs any authorising group, one with a
    group needs that group. Subscriptions of one client stay apart.
    """
    rights = watchers.select(
        F.col("owner_id").alias("target_user_id"),
        "metric_type",
        F.col("watcher_id").alias("viewer_id"),
        F.col("group_id").cast("string").alias("right_group"),
    )
    # '' matches the repeated right without a group, so one equi join covers both kinds
    any_group = rights.withColumn("right_group", F.explode(F.array(F.col("right_group"), F.lit("")))).distinct()
    live = subscriptions.join(
        any_group.withColumnRenamed("right_group", "group_id"),
        ["target_user_id", "metric_type", "viewer_id", "group_id"],
        "left_semi",
    ).select(*KEY, "viewer_id")
    return readings.withColumnRenamed("user_id", "target_user_id").join(live, ["target_user_id", "metric_type"])


def broadcast_as_of(
    readings: DataFrame, subscription_spans: DataFrame, permission_spans: DataFrame, key: str
) -> DataFrame:
    """Replay: deliveries under the subscriptions and permissions in force at each reading's time.

    Both interval tables are covered by dyadic blocks of time, so a span costs a
    few rows however long it is and a reading meets only spans of its own blocks.
    ``key`` names the reading's unique column; permission_spans: owner_id,
    metric_type, watcher_id, group_id, from_ts, to_ts.
    """
    on = ["target_user_id", "metric_type", "viewer_id", "group_id"]
    spans = cut_lineage(subscription_spans)
    rights = permission_spans.select(
        F.col("owner_id").alias("target_user_id"),
        "metric_type",
        F.col("watcher_id").alias("viewer_id"),
        F.explode(F.array(F.col("group_id").cast("string"), F.lit(""))).alias("group_id"),
        "from_ts",
        "to_ts",
    )
    # A right nobody subscribed under and a subscription without a right deliver nothing: neither is indexed by time.
    rights = cut_lineage(rights.join(spans.select(*on), on, "left_semi").distinct())
    timed = readings.withColumnRenamed("user_id", "target_user_id")
    allowed = spans.join(rights.select(*on), on, "left_semi").select(subscription_spans.columns)
    subscribed = in_force(timed, allowed, ["target_user_id", "metric_type"], "time", "from_ts", "to_ts")
    return (
        in_force(subscribed, rights, on, "time", "from_ts", "to_ts")
        .select(key, "target_user_id", "metric_type", "client_id", "viewer_id", "group_id")
        .distinct()
    )
