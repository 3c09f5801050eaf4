"""Streams give what the batch operators give."""

import json

from helpers import rows
from pyspark.sql import functions as F

from vitalgrid.operators import access, alerts, changes, fanout, gateway, series
from vitalgrid.plans import live
from vitalgrid.sources import readings as source
from vitalgrid.sources.views import Dataset
from vitalgrid.streaming import state, streams

SF = "/root/testdata/sf0.001"


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def in_files(df, folder, n=3):
    for i in range(n):
        df.filter(F.pmod(F.xxhash64(df.columns[0]), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_ingest_first_write_wins(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    msg = lambda u, v, t="2024-01-01T00:00:00Z": json.dumps({"user_id": u, "metric_type": "spo2", "value": v, "timestamp": t})
    batches = [
        [(1, msg("1", 1)), (2, msg("1", 2)), (3, "{bad")],
        [(4, msg("1", 3)), (5, msg("1", 4, "1999-01-01T00:00:00Z")), (6, msg("77", 5))],
    ]
    types = spark.createDataFrame([("spo2",)], "name string")
    users = spark.createDataFrame([(1,)], "id bigint")
    store, bad, ck = (str(tmp_path / d) for d in ("store", "bad", "ck"))
    for i, rows_ in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"seq": s, "message": m}) for s, m in rows_))
        run(streams.stream_ingest(streams.message_stream(spark, str(src), 1), store, bad, lambda: types, lambda: users, ck))
    stored = streams.stored_readings(spark, store)
    assert sorted((r.seq, r.value) for r in stored.collect()) == [(1, 1.0), (5, 4.0)]
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["invalid_json", "unknown_user"]
    # a retried batch replaces its own rows
    again = spark.createDataFrame(batches[1], "seq bigint, message string")
    streams.ingest_batch(again, 1, store, bad, lambda: types, lambda: users)
    assert sorted(r.seq for r in streams.stored_readings(spark, store).collect()) == [1, 5]


def test_chart_alerts_and_broadcast(spark, tmp_path):
    ds = Dataset(spark, SF)
    readings = ds.view("v_readings")
    schema = readings.schema
    folder = in_files(readings, tmp_path / "readings")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    run(streams.stream_chart(stream(), str(tmp_path / "roll"), str(tmp_path / "c1")))
    rounded = lambda df: rows(df.withColumn("value", F.round("value", 6)))
    want = series.read_rollup(series.rollup_deltas(readings), ds.view("v_metric_types"))
    assert rounded(streams.read_chart(spark, str(tmp_path / "roll"), ds.view("v_metric_types"))) == rounded(want)
    assert streams.batches_done(spark, str(tmp_path / "roll")) == 3

    tables = {
        "metric_types": "v_metric_types", "thresholds": "v_thresholds", "permissions": "v_sharing_permissions",
        "members": "v_group_members", "users": "v_users", "groups": "v_groups",
    }
    live_tables = {k: (lambda v=v: ds.view(v)) for k, v in tables.items()}
    run(streams.stream_alerts(stream(), live_tables, str(tmp_path / "alerts"), str(tmp_path / "c2")))
    from vitalgrid.plans.alerts import messages

    cols = ["recipient_id", "event_id", "body"]
    assert rows(spark.read.parquet(str(tmp_path / "alerts")).select(cols)) == rows(messages(ds).select(cols))

    subs = fanout.subscription_state(live.control(ds))
    live_tables["subscriptions"] = lambda: subs
    run(streams.stream_broadcast(stream(), live_tables, str(tmp_path / "out"), str(tmp_path / "c3")))
    cols = ["event_id", "client_id", "group_id"]
    want = fanout.broadcast_fanout(readings, subs, live.watchers(ds)).select(cols)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(cols)) == rows(want)


def test_chart_compaction(spark, tmp_path):
    """Ten batches, three to a level: what is read stays whole and small, and retried batches change nothing."""
    roll = str(tmp_path / "roll")
    types = spark.createDataFrame([("spo2", "SUM")], "name string, agg string")
    total = lambda: rows(streams.read_chart(spark, roll, types, 3).filter("bucket = '1 day'").select("value"))
    at = "2024-01-01 10:00:00"
    batch = lambda i: spark.createDataFrame([(1, "spo2", float(2**i), at)], "user_id bigint, metric_type string, value double, time string").select(
        "user_id", "metric_type", "value", F.to_timestamp("time").alias("time")
    )
    assert streams.read_chart(spark, roll, types, 3).count() == 0
    for i in range(10):
        streams.chart_batch(batch(i), i, roll, 3)
        if i == 8:
            streams.chart_batch(batch(i), i, roll, 3)  # retried after its mark
            # a later batch that failed before its mark is not read, and is replaced
            batch(3).write.parquet(f"{roll}/level=0/upto=10")
        assert total() == rows(spark.createDataFrame([(float(2 ** (i + 1) - 1),)], "value double"))
    assert streams.live_folders(10, 3) == ["level=0/upto=10", "level=2/upto=9"]
    assert all(len(streams.live_folders(n, 8)) <= 7 * 5 for n in range(8**4, 8**4 + 3000))
    covered = lambda n: sum(3 ** int(f[6:f.index("/")]) for f in streams.live_folders(n, 3))
    assert all(covered(n) == n for n in range(200))


def test_publish_survives_a_half_written_batch(spark, tmp_path):
    """Files that no commit names are not read; a resumed stream adds each reading once."""
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "user_id bigint, metric_type string, value double, time timestamp"
    one = lambda u: spark.sql(f"SELECT {u}L AS user_id, 'spo2' AS metric_type, 1D AS value, TIMESTAMP '2024-01-01 00:00:00' AS time")
    publish = lambda: run(streams.stream_publish(spark.readStream.schema(schema).parquet(src), out, ck))
    one(1).write.parquet(src)
    publish()
    one(9).select(F.lit("9").alias("key"), F.lit("{}").alias("value")).write.mode("append").parquet(str(tmp_path / "stray"))
    for f in (tmp_path / "stray").glob("*.parquet"):
        (tmp_path / "out" / f.name).write_bytes(f.read_bytes())
    one(2).write.mode("append").parquet(src)
    publish()
    publish()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_stored_slices_are_even(spark, tmp_path):
    """A day of 40,000 readings, most of them one user's, beside a day of three."""
    frame = spark.range(40_003).select(
        F.when(F.col("id") % 10 < 8, "1").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit("spo2").alias("metric_type"), F.lit(1.0).alias("value"),
        F.timestamp_seconds(F.when(F.col("id") < 40_000, 0).otherwise(86_400) + F.col("id")).alias("time"),
    )
    frame = frame.withColumn("date", F.to_date("time"))
    sizes = {}
    for r in source.sliced(frame, 4_000).groupBy("date", "slice").count().collect():
        sizes.setdefault(str(r["date"]), []).append(r["count"])
    busy, quiet = sizes["1970-01-01"], sizes["1970-01-02"]
    assert len(busy) == 10 and max(busy) < 2 * min(busy) and quiet == [3]
    source.store_readings(frame, str(tmp_path / "s"), per_slice=4_000)
    assert len(list((tmp_path / "s/metric_type=spo2/date=1970-01-01").glob("slice=*/*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path / "s")).count() == 40_003


def test_state_machines_equal_batch(spark, tmp_path):
    ds = Dataset(spark, SF)
    # pending timers would keep an availableNow query running empty batches for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def collected(make, frame, name):
        folder = in_files(frame, tmp_path / name, 1)
        stream = spark.readStream.schema(frame.schema).parquet(folder)
        out = make(stream)
        q = (
            out.writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / (name + "-ck"))).trigger(availableNow=True).start()
        )
        run(q)
        return spark.table(name)

    requests = ds.view("v_requests")
    got = collected(lambda s: state.limited_requests(s, 3, 7200), requests, "limits")
    assert rows(got.fillna(-1)) == rows(gateway.rate_limit(requests, 3, 7200).select(got.columns).fillna(-1))

    events = live.control(ds)
    got = collected(state.subscription_changes, events, "subs")
    last = got.groupBy(*fanout.KEY).agg(F.max_by("live", "seq").alias("live")).filter("live").select(*fanout.KEY)
    assert rows(last) == rows(fanout.subscription_state(events).select(*fanout.KEY))

    from vitalgrid.plans.people import MEMBER_EVENTS

    member_events = ds.sql(MEMBER_EVENTS, ["v_groups"])
    flat = changes.membership_events(member_events, ds.view("v_groups"))
    got = collected(state.membership_changes, flat, "members")
    want = changes.membership_steps(member_events, ds.view("v_groups")).select("group_id", "user_id", "seq", "before", "after")
    assert rows(got) == rows(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class _Window:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    """State and timers of one key; ``pass_time`` fires what is due, as the engine does between batches."""

    def __init__(self):
        self.window, self.timers, self.now = _Window(), set(), 0

    def getValueState(self, name, schema):
        return self.window

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def pass_time(self, processor, until):
        self.now = until
        for at in sorted(t for t in self.timers if t <= until):
            self.timers.discard(at)
            list(processor.handleExpiredTimer(("k",), self, type("Info", (), {"getExpiryTimeInMs": lambda _, at=at: at})()))


def test_limiter_keeps_a_touched_window():
    """Three batches 0, 21 and 41 s apart in wall time, all in one window of event time."""
    import pandas as pd

    from vitalgrid.streaming.state import LimiterProcessor

    handle, limiter = _Handle(), LimiterProcessor(limit=2, window=15)
    limiter.init(handle)
    seen = []
    for event, wall in enumerate((0, 21_000, 41_000)):
        handle.pass_time(limiter, wall)
        rows = iter([pd.DataFrame({"event_id": [event], "entry": [1_000_000 * event]})])
        seen += [(r.n, r.blocked) for out in limiter.handleInputRows(("k",), rows, handle) for r in out.itertuples()]
    assert seen == [(1, False), (2, False), (3, True)] and len(handle.timers) == 1
    handle.pass_time(limiter, 80_000)
    assert not handle.window.exists() and not handle.timers
