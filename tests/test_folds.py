"""Order-dependent operators against step-by-step replays, and the aggregates they build on."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from vitalgrid.functions import intervals
from vitalgrid.functions.asof import last_before, next_event
from vitalgrid.functions.intervals import in_force
from vitalgrid.functions.numbers import two_decimals
from vitalgrid.functions.skew import first_by, last_by
from vitalgrid.operators import changes, fanout, gateway, meds

T0 = datetime(2024, 1, 1)


def test_first_and_last_by(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "k int, seq int, v string")
    assert rows(first_by(df, ["k"], [F.col("seq")])) == [(1, 1, "a")]
    assert rows(last_by(df, ["k"], [F.col("seq")])) == [(1, 3, None)]


def test_next_and_last_event(spark):
    rnd = random.Random(1)
    left = [(rnd.randrange(3), s) for s in rnd.sample(range(200), 60)]
    events = [(rnd.randrange(3), s, f"e{s}") for s in rnd.sample(range(200), 25)]
    ldf = spark.createDataFrame(left, "k int, seq bigint")
    edf = spark.createDataFrame(events, "k int, seq bigint, p string")
    nxt = rows(next_event(ldf, edf, ["k"], "seq", "n", 16).fillna(-1))
    assert nxt == sorted((k, s, min([e for q, e, _ in events if q == k and e > s], default=-1)) for k, s in left)
    prev = rows(last_before(ldf, edf, ["k"], "seq", "p", "b", 16).fillna(""))
    assert prev == sorted((k, s, max([(e, p) for q, e, p in events if q == k and e < s], default=(0, ""))[1]) for k, s in left)


def test_two_decimals_prints_like_c(spark):
    rnd = random.Random(2)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, 0.0, 99.995, 1234.565, 1e12 + 0.125, 1e12 + 0.375, 2.0**49 + 0.125, -1e13 - 0.875, 2.0**60, -(2.0**53), 0.995, 7.0] + [rnd.randrange(10**6) / 1000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("s", two_decimals(F.col("x")))
    assert [(r.x, r.s) for r in df.collect() if r.s != "%.2f" % r.x] == []


def replay_limit(events, limit, window):
    state, out = {}, []
    for ts, eid, key in sorted(events):
        opened, n = state.get(key, (None, 0))
        if opened is None or ts >= opened + timedelta(seconds=window):
            opened, n = ts, 0
        n += 1
        state[key] = (opened, n)
        out.append((eid, n, max(limit - n, 0), n > limit))
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4, 37, 1_000_000])
def test_rate_limit_over_block_borders(spark, monkeypatch, block_rows):
    """Key a holds two thirds of all requests; no task's block of it passes the bound."""
    monkeypatch.setattr(gateway, "BLOCK_ROWS", block_rows)
    rnd = random.Random(3)
    events = [(T0 + timedelta(seconds=rnd.randrange(4000), microseconds=rnd.randrange(10**6)), i, rnd.choice("aab")) for i in range(400)]
    df = spark.createDataFrame([(i, k, None, "x", ts) for ts, i, k in events], "event_id bigint, sub string, api_key string, ip string, ts timestamp")
    got = gateway.rate_limit(df, limit=3, window=20).select("event_id", "n", "remaining", "blocked")
    assert rows(got) == replay_limit(events, 3, 20)
    slots = df.groupBy(F.col("sub").alias("key"), F.floor(F.unix_seconds("ts") / 20).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    blocks = gateway._grouped(slots, "slot", "block").join(slots, ["key", "slot"]).groupBy("key", "block").agg(F.sum(F.least("n", F.lit(block_rows // 2))).alias("n"))
    assert all(r.n < 1.5 * block_rows for r in blocks.collect())


def test_points_in_intervals(spark):
    rnd = random.Random(8)
    spread = [10**6, 10**9, 10**12, 10**14]
    at = lambda: T0 + timedelta(microseconds=rnd.randrange(-1, 2) * rnd.randrange(rnd.choice(spread)))
    points = [(i, rnd.choice("ab"), at()) for i in range(120)] + [(900, "a", None), (901, None, T0), (902, "z", T0), (903, "a", datetime(1600, 1, 1)), (904, "a", datetime(2400, 1, 1))]
    spans = [(i, rnd.choice("ab"), at(), rnd.choice([None, at(), at()])) for i in range(150)]
    spans += [(900, "a", None, T0), (901, None, T0, None), (902, "a", T0, T0), (903, "a", datetime(1500, 1, 1), datetime(1700, 1, 1)), (904, "a", datetime(2300, 1, 1), None)]
    spans += [(905, "a", points[0][2], points[0][2] + timedelta(microseconds=1)), (905, "a", points[0][2], points[0][2] + timedelta(microseconds=1))]
    want = sorted(
        (p, k, t, s) for p, k, t in points for s, kk, a, b in spans
        if k is not None and k == kk and t is not None and a is not None and a <= t and (b is None or t < b)
    )
    left = spark.createDataFrame(points, "p int, k string, t timestamp")
    right = spark.createDataFrame(spans, "s int, k string, a timestamp, b timestamp")
    assert sorted(tuple(r) for r in in_force(left, right, ["k"], "t", "a", "b").select("p", "k", "t", "s").collect()) == want
    assert in_force(left, right.limit(0), ["k"], "t", "a", "b").collect() == []
    # A hundred years are a few blocks, not one row a day.
    century = spark.range(1).select(intervals.cell(F.lit(T0)).alias("x"), intervals.cell(F.lit(T0 + timedelta(days=36_500))).alias("y"))
    assert century.select(F.size(intervals._blocks("x", "y"))).first()[0] <= 2 * intervals.LEVELS


def test_toggle_takes_replay(spark):
    rnd = random.Random(4)
    first = datetime(2024, 1, 1, 3)
    initial = {r: (None if r % 3 == 0 else first) for r in range(30)}
    takes = [(r, first + timedelta(hours=rnd.randrange(1, 60), minutes=i)) for r in range(30) for i in range(rnd.randrange(6))]
    offset = timedelta(hours=7)
    state = dict(initial)
    for r, ts in sorted(takes, key=lambda t: t[1]):
        last = state[r]
        same = last is not None and (last + offset).date() == (ts + offset).date()
        state[r] = None if same else ts
    rem = spark.createDataFrame([(r, 1, t) for r, t in initial.items()], "id bigint, medication_id bigint, last_taken timestamp")
    med = spark.createDataFrame([(1, 9)], "id bigint, user_id bigint")
    users = spark.createDataFrame([(9, "Asia/Ho_Chi_Minh")], "id bigint, timezone string")
    ev = spark.createDataFrame([(1, r, 9, ts) for r, ts in takes], "medication_id bigint, reminder_id bigint, user_id bigint, ts timestamp")
    got = {r.id: r.last_taken for r in meds.toggle_takes(rem, med, ev, users).collect()}
    assert got == state


def test_membership_replay(spark):
    rnd = random.Random(5)
    groups = spark.createDataFrame([(1, 100)], "id bigint, owner_id bigint")
    evs = []
    for seq in range(600):
        action = rnd.choice(["invite", "respond", "approve", "reject"])
        evs.append((seq, rnd.choice([1, 1, 2]), rnd.randrange(40), rnd.choice([100, 7]), action, rnd.choice(["accepted", "rejected", "pending"]), T0))
    state, want = {}, []
    for seq, g, u, actor, action, status, _ in evs:
        s = before = state.get((g, u), "none")
        asked = "pending_owner_approval" if status == "accepted" else status
        if action == "invite" and g == 1 and s == "none":
            s = "pending"
        elif action == "respond" and s == "pending" and asked != "pending":
            s = asked
        elif action in ("approve", "reject") and g == 1 and actor == 100 and s == "pending_owner_approval":
            s = "accepted" if action == "approve" else "rejected"
        state[(g, u)] = s
        want.append((seq, before, s))
    df = spark.createDataFrame(evs, "seq bigint, group_id bigint, user_id bigint, actor_id bigint, action string, status string, ts timestamp")
    got = changes.membership_steps(df, groups).select("seq", "before", "after")
    assert rows(got) == sorted(want)


def test_subscription_state_replay(spark):
    rnd = random.Random(6)
    evs = [
        (s, rnd.randrange(4), 1, rnd.randrange(3), "hr", rnd.choice(["", "5"]), rnd.choice(["subscribe"] * 6 + ["unsubscribe"] * 3 + ["disconnect"]), T0 + timedelta(minutes=s))
        for s in range(300)
    ]
    live = set()
    for _, c, _, t, m, g, action, _ in evs:
        if action == "disconnect":
            live = {k for k in live if k[0] != c}
        elif action == "subscribe":
            live.add((c, t, m, g))
        else:
            live.discard((c, t, m, g))
    df = spark.createDataFrame(evs, "seq bigint, client_id bigint, viewer_id bigint, target_user_id bigint, metric_type string, group_id string, action string, ts timestamp")
    assert rows(fanout.subscription_state(df).select(*fanout.KEY)) == sorted(live)
    open_now = fanout.subscription_intervals(df).filter("to_ts IS NULL").select(*fanout.KEY)
    assert rows(open_now) == sorted(live)


def test_permission_changes_one_scope(spark):
    perms = spark.createDataFrame([(1, 5, "hr", None), (1, 5, "access_control", 6), (1, 5, "hr", 6)], "group_id bigint, user_id bigint, metric_type string, shared_with_user_id bigint")
    members = spark.createDataFrame([(1, 5, "accepted"), (1, 6, "accepted")], "group_id bigint, user_id bigint, status string")
    types = spark.createDataFrame([("hr",), ("spo2",)], "name string")
    ch = [
        (1, "set", 1, 5, 6, ["spo2"]),  # not in the base yet: refused, but the old rows go
        (2, "enable", 1, 5, None, ["spo2"]),
        (3, "set", 1, 5, 7, ["spo2"]),  # now it is
        (4, "disable", 1, 5, None, ["spo2"]),
        (5, "enable", 1, 5, 6, ["hr"]),
        (6, "set", 1, 8, None, ["hr"]),
        (7, "set", 1, 5, None, ["mood"]),
    ]
    df = spark.createDataFrame(ch, "seq bigint, op string, group_id bigint, user_id bigint, viewer_id bigint, metrics array<string>")
    table, verdicts = changes.apply_permission_changes(perms, members, types, df)
    assert {r.seq: r.verdict for r in verdicts.collect()} == {
        1: "not_in_base", 2: "ok", 3: "ok", 4: "ok", 5: "use_list", 6: "not_member", 7: "invalid_metric",
    }
    got = {(r.metric_type, r.shared_with_user_id) for r in table.collect()}
    assert got == {("hr", None), ("access_control", 7), ("spo2", 7)}


def test_missed_reminders_edges(spark):
    meds_df = spark.createDataFrame([(1, 9, "m", True, datetime(2024, 1, 1).date(), None)], "id bigint, user_id bigint, name string, is_active boolean, start_date date, end_date date")
    rem = spark.createDataFrame(
        [(11, 1, "08:00", True, None), (12, 1, "8:30", True, None), (13, 1, "late", True, None), (14, 1, "23:00", True, None), (15, 1, "07:00", True, datetime(2024, 3, 31, 4))],
        "id bigint, medication_id bigint, time string, is_enabled boolean, last_taken timestamp",
    )
    shares = spark.createDataFrame(
        [(1, 1, 2, 15, None, None), (2, 1, 3, 15, 11, None), (3, 1, 4, 15, 11, datetime(2024, 3, 30).date())],
        "id bigint, medication_id bigint, shared_with_user_id bigint, notify_offset_minutes int, last_notified_reminder_id bigint, last_notified_date date",
    )
    # clocks went forward in Paris that night; an unknown zone counts as UTC
    for zone, now, want in (("Europe/Paris", "2024-03-31 07:00:00", {11, 12}), ("Nowhere/Else", "2024-03-31 08:20:00", {11})):
        users = spark.createDataFrame([(9, zone)], "id bigint, timezone string")
        got = meds.missed_reminders(shares, meds_df, rem, users, now).collect()
        assert {r.reminder_id for r in got if r.share_id == 1} == want
        assert 11 not in {r.reminder_id for r in got if r.share_id == 2}
        assert 11 in {r.reminder_id for r in got if r.share_id == 3}


def test_only_rights_that_meet_a_subscription_are_indexed_by_time(spark, monkeypatch):
    """Of 60 rights and 41 subscriptions one pair meets: the time index gets no other, and the deliveries are those of the pair."""
    from datetime import datetime

    from vitalgrid.operators import fanout

    day = lambda d: datetime(2024, 1, d)
    rights = [(1, "hr", 100 + i, 7, day(2), day(20)) for i in range(60)]
    spans = [(9, 1, "hr", "", 100, day(1), None)] + [(i, 1, "hr", "", 500 + i, day(1), None) for i in range(39)] + [(9, 1, None, "", 100, day(1), None)]
    readings = [(k, 1, "hr", day(k)) for k in range(1, 28)]
    held = []

    def watched(points, intervals, *more):
        held.append(intervals.count())
        return in_force(points, intervals, *more)

    monkeypatch.setattr(fanout, "in_force", watched)
    out = fanout.broadcast_as_of(
        spark.createDataFrame(readings, "event_id long, user_id long, metric_type string, time timestamp"),
        spark.createDataFrame(spans, "client_id long, target_user_id long, metric_type string, group_id string, viewer_id long, from_ts timestamp, to_ts timestamp"),
        spark.createDataFrame(rights, "owner_id long, metric_type string, watcher_id long, group_id long, from_ts timestamp, to_ts timestamp"),
        "event_id",
    )
    assert sorted((r.event_id, r.client_id, r.viewer_id, r.group_id) for r in out.collect()) == [(k, 9, 100, "") for k in range(2, 20)]
    assert held == [1, 1]
