"""Request accounting: rate limits and latency histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.session import cut_lineage

# Histogram bounds in seconds. Fixed values.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# Rows of a key that one task takes at a time.
BLOCK_ROWS = 1_000_000


def request_stats(requests: DataFrame) -> DataFrame:
    """Count, latency sum and cumulative histogram per (method, path, status)."""
    named = requests.withColumn("path", F.when(F.col("path") == "", "unknown").otherwise(F.col("path")))
    counts = [
        F.count_if(F.col("seconds") <= b).alias("le_" + str(b).replace(".", "_").removesuffix("_0"))
        for b in LATENCY_BOUNDS
    ]
    return named.groupBy("method", "path", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("sum_seconds"), *counts, F.count(F.lit(1)).alias("le_inf")
    )


def identity():
    """Whose quota a request uses: user, else API key, else address."""
    return (
        F.when(F.col("sub").isNotNull(), F.concat(F.lit("user:"), "sub"))
        .when(F.coalesce("api_key", F.lit("")) != "", F.concat(F.lit("apikey:"), "api_key"))
        .otherwise(F.concat(F.lit("ip:"), F.coalesce("ip", F.lit(""))))
    )


def _follow(entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Where a chain of windows that enters at each entry finally leaves: pointer doubling."""
    n = len(entry)
    jump = np.searchsorted(entry, leave, side="left")
    # the last window of the block points at itself
    jump = np.where(jump < n, jump, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return leave[jump]
        jump = further


def _summarise(window: int):
    """Shrink a block to its possible entries: requests a chain from outside can open a window at.

    Such a chain carries an expiry below block start + window, so only requests
    up to there, and the first after, can be entered.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry")
        entry = pdf["entry"].to_numpy()
        leave = _follow(entry, pdf["leave"].to_numpy())
        start = int(entry[0]) // window * window
        keep = min(len(entry), int(np.searchsorted(entry, start + window, side="left")) + 1)
        entry, leave = entry[:keep], leave[:keep]
        # of neighbours with one exit the last stands for all
        last = np.append(leave[1:] != leave[:-1], True)
        return pd.DataFrame({"key": key[0], "block": key[1], "entry": entry[last], "leave": leave[last]})

    return run


def _carry(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Hand the expiry through the blocks of a group, in order, beginning with the group's own carry."""
    pdf = pdf.sort_values("entry")
    expiry = int(pdf["carry"].iloc[0])
    blocks, carries = [], []
    for block, part in pdf.groupby("block", sort=True):
        blocks.append(block)
        carries.append(expiry)
        entry = part["entry"].to_numpy()
        at = int(np.searchsorted(entry, expiry, side="left"))
        if at < len(entry):
            expiry = int(part["leave"].to_numpy()[at])
    return pd.DataFrame({"key": key[0], "block": blocks, "carry": carries})


def _openings(window: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["entry"].to_numpy())
        expiry = int(pdf["carry"].iloc[0])
        opened = []
        at = int(np.searchsorted(times, expiry, side="left"))
        while at < len(times):
            opened.append(int(times[at]))
            at = int(np.searchsorted(times, opened[-1] + window, side="left"))
        return pd.DataFrame({"key": key[0], "opened": np.array(opened, dtype="int64")})

    return run


def _grouped(counts: DataFrame, unit: str, out: str) -> DataFrame:
    """(key, unit, n) -> (key, unit, out): neighbouring units of a key in groups of about ``BLOCK_ROWS`` rows.

    A unit counts for half of ``BLOCK_ROWS`` at most, so a group always takes in
    two; it holds less than one and a half times ``BLOCK_ROWS`` rows, unless
    single units are larger than half of it (at most three in a group).
    """
    before = Window.partitionBy("key").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.least("n", F.lit(max(1, BLOCK_ROWS // 2)))
    return counts.withColumn("weight", weight).select(
        "key", unit, F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0)) / BLOCK_ROWS).cast("bigint").alias(out)
    )


def window_openings(times: DataFrame, window: int) -> DataFrame:
    """Start of every limiter window: (key, opened), both from (key, entry) in microseconds.

    A window opens at the first request at or after the previous one's expiry,
    which chains a key's whole history. The chain is cut into blocks of
    neighbouring requests; the borders come from counts per window length, so a
    block has about ``BLOCK_ROWS`` requests however busy the key is. A block maps
    an incoming expiry to an outgoing one. Maps are joined, again in groups cut
    by their counts, until a key has one, and expiries handed down again.
    """
    map_schema = "key string, block bigint, entry bigint, leave bigint"
    carry_schema = "key string, block bigint, carry bigint"
    slotted = times.distinct().withColumn("slot", F.floor(F.col("entry") / F.lit(window)).cast("bigint"))
    borders = cut_lineage(_grouped(slotted.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n")), "slot", "block"))
    base = cut_lineage(slotted.join(borders, ["key", "slot"]).drop("slot"))
    parents: list[DataFrame] = []
    maps: list[DataFrame] = []
    rows = base.withColumn("leave", F.col("entry") + F.lit(window))
    most = borders.agg(F.max("block")).first()[0]
    while most:
        maps.append(cut_lineage(rows.groupBy("key", "block").applyInPandas(_summarise(window), map_schema)))
        sizes = maps[-1].groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
        parents.append(cut_lineage(_grouped(sizes, "block", "parent")))
        rows = maps[-1].join(parents[-1], ["key", "block"]).select("key", F.col("parent").alias("block"), "entry", "leave")
        most = parents[-1].agg(F.max("parent")).first()[0]
    # At the top a key has one block, and nothing is carried in.
    carries = base.select("key").distinct().select("key", F.lit(0).cast("bigint").alias("block"), F.lit(-(2**62)).alias("carry"))
    for table, parent in zip(reversed(maps), reversed(parents), strict=True):
        carries = (
            table.join(parent, ["key", "block"])
            .join(carries.withColumnRenamed("block", "parent"), ["key", "parent"])
            .groupBy("key", "parent")
            .applyInPandas(_carry, carry_schema)
        )
    return base.join(carries, ["key", "block"]).groupBy("key", "block").applyInPandas(
        _openings(window), "key string, opened bigint"
    )


def rate_limit(requests: DataFrame, limit: int = 100, window: int = 60) -> DataFrame:
    """Fixed-window verdict per request: count in window, remaining, blocked, retry_after.

    ``requests``: event_id, sub, api_key, ip, ts. A window opens at a key's
    first request after the last one expired; blocked requests count too.
    """
    micros = window * 1_000_000
    keyed = requests.withColumn("key", identity()).withColumn("entry", F.unix_micros("ts"))
    slot = lambda c: F.floor(c / F.lit(micros)).cast("bigint")
    opened = window_openings(keyed.select("key", "entry"), micros)
    # two windows never open in one slot of the same length, so a request belongs
    # to the one opened in its own slot or the slot before
    near = opened.withColumn("slot", F.explode(F.array(slot(F.col("opened")), slot(F.col("opened")) + 1)))
    placed = (
        keyed.withColumn("slot", slot(F.col("entry")))
        .join(near, ["key", "slot"])
        .filter((F.col("opened") <= F.col("entry")) & (F.col("entry") < F.col("opened") + F.lit(micros)))
    )
    w = Window.partitionBy("key", "opened").orderBy("entry", "event_id")
    counted = placed.withColumn("n", F.row_number().over(w).cast("bigint"))
    left_us = F.col("opened") + F.lit(micros) - F.col("entry")
    blocked = F.col("n") > limit
    return counted.select(
        "event_id",
        "key",
        "n",
        F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).cast("bigint").alias("remaining"),
        blocked.alias("blocked"),
        # the store reports the time left rounded to whole seconds
        F.when(blocked, F.floor((left_us + 500_000) / F.lit(1_000_000)).cast("bigint")).alias("retry_after"),
    )
