"""State machines for live streams: one key at a time, state of constant size.

The batch operators give the same answers over a finished history; these keep
them current while messages arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalgrid.operators.gateway import identity


class SubscriptionProcessor(StatefulProcessor):
    """Per client: which (target, metric, group) are live; a disconnect clears them all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState(
            "live", "target_user_id bigint, metric_type string, group_id string", "viewer_id bigint, seq bigint"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        client = key[0]
        out = []
        batch = pd.concat(list(rows)).sort_values("seq")
        for r in batch.itertuples(index=False):
            if r.action == "disconnect":
                for k, v in list(self.live.iterator()):
                    out.append((client, *k, v[0], int(r.seq), False))
                self.live.clear()
                continue
            slot = (int(r.target_user_id), r.metric_type, r.group_id)
            if r.action == "subscribe":
                self.live.updateValue(slot, (int(r.viewer_id), int(r.seq)))
                out.append((client, *slot, int(r.viewer_id), int(r.seq), True))
            elif self.live.containsKey(slot):
                self.live.removeKey(slot)
                out.append((client, *slot, int(r.viewer_id), int(r.seq), False))
        yield pd.DataFrame(out, columns=SUBSCRIPTION_COLUMNS)

    def close(self) -> None:
        pass


SUBSCRIPTION_COLUMNS = ["client_id", "target_user_id", "metric_type", "group_id", "viewer_id", "seq", "live"]
SUBSCRIPTION_SCHEMA = (
    "client_id bigint, target_user_id bigint, metric_type string, group_id string, viewer_id bigint, seq bigint, live boolean"
)


def subscription_changes(events: DataFrame) -> DataFrame:
    """Stream of what each control event switched on or off."""
    return events.groupBy("client_id").transformWithStateInPandas(
        SubscriptionProcessor(), SUBSCRIPTION_SCHEMA, outputMode="Append", timeMode="None"
    )


class MembershipProcessor(StatefulProcessor):
    """Per (group, user): the membership status; rows carry action, asked, is_owner and group_found."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.status.get()[0] if self.status.exists() else "none"
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            before = state
            if r.action == "invite":
                state = "pending" if r.group_found and state == "none" else state
            elif r.action == "respond":
                state = r.asked if state == "pending" and r.asked in ("pending_owner_approval", "rejected") else state
            elif r.is_owner and state == "pending_owner_approval":
                state = "accepted" if r.action == "approve" else "rejected"
            out.append((key[0], key[1], int(r.seq), before, state))
        if state != "none":
            self.status.update((state,))
        yield pd.DataFrame(out, columns=["group_id", "user_id", "seq", "before", "after"])

    def close(self) -> None:
        pass


def membership_changes(rows: DataFrame) -> DataFrame:
    """Stream of status changes; ``rows`` come from ``membership_events``."""
    return rows.groupBy("group_id", "user_id").transformWithStateInPandas(
        MembershipProcessor(),
        "group_id bigint, user_id bigint, seq bigint, before string, after string",
        outputMode="Append",
        timeMode="None",
    )


class LimiterProcessor(StatefulProcessor):
    """Per identity: start of the open window and its count; a timer drops expired windows."""

    def __init__(self, limit: int, window: int):
        self.limit = limit
        self.micros = window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, n bigint, expires bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, n, expires = self.window.get() if self.window.exists() else (None, 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["entry", "event_id"]).itertuples(index=False):
            entry = int(r.entry)
            if opened is None or entry >= opened + self.micros:
                opened, n = entry, 0
            n += 1
            blocked = n > self.limit
            left = (opened + self.micros - entry + 500_000) // 1_000_000 if blocked else None
            out.append((int(r.event_id), key[0], n, max(self.limit - n, 0), blocked, left))
        # Windows open and close in event time. Wall time only frees state: a window nobody has
        # touched for twice its length is dropped, so each touch moves the one timer.
        if expires is not None:
            self.handle.deleteTimer(expires)
        expires = timerValues.getCurrentProcessingTimeInMs() + 2 * self.micros // 1000
        self.handle.registerTimer(expires)
        self.window.update((opened, n, expires))
        frame = pd.DataFrame(out, columns=["event_id", "key", "n", "remaining", "blocked", "retry_after"])
        frame["retry_after"] = frame["retry_after"].astype("Int64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer that a later touch replaced says nothing about the window.
        if self.window.exists() and self.window.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_requests(requests: DataFrame, limit: int = 100, window: int = 60) -> DataFrame:
    """Stream of limiter verdicts, in the shape of ``rate_limit``.

    Open windows hold timers, for which a query runs empty batches; a bounded
    run (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled=false
    to end.
    """
    from pyspark.sql import functions as F

    keyed = requests.select("event_id", identity().alias("key"), F.unix_micros("ts").alias("entry"))
    return keyed.groupBy("key").transformWithStateInPandas(
        LimiterProcessor(limit, window),
        "event_id bigint, key string, n bigint, remaining bigint, blocked boolean, retry_after bigint",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
