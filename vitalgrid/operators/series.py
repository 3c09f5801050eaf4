"""Time-bucket charts over the long reading table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.access import check_access
from vitalgrid.session import cut_lineage

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Bucket text -> width in microseconds. Weeks start on Mondays, counted from 2000-01-03.
WIDTHS = {"15 minutes": HOUR_US // 4, "1 hour": HOUR_US, "1 day": DAY_US, "1 week": 7 * DAY_US}
MONDAY_US = 946_857_600_000_000


def bucket_start(time: Column, width_us: Column) -> Column:
    """Start of the bucket that holds ``time``; one expression for every width."""
    micros = F.unix_micros(time)
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(MONDAY_US), width_us))


def bucket_width(bucket: Column) -> Column:
    width = F.lit(None).cast("bigint")
    for text, micros in WIDTHS.items():
        width = F.when(bucket == text, F.lit(micros)).otherwise(width)
    return width


def chart_plan(requests: DataFrame) -> DataFrame:
    """Resolve range keywords: adds start_time, end_time, bucket and status.

    ``requests`` holds range, start, end and now; unknown keywords mean 7 days.
    Status is ok, missing_times or invalid_range (longer than 365 days).
    """
    custom = F.col("range") == "custom"
    back = F.when(F.col("range") == "24h", F.lit(1)).when(F.col("range") == "30d", F.lit(30)).otherwise(F.lit(7))
    start = F.when(custom, F.col("start")).otherwise(
        F.timestamp_micros(F.unix_micros("now") - back.cast("bigint") * F.lit(DAY_US))
    )
    end = F.when(custom, F.col("end")).otherwise(F.col("now"))
    missing = custom & (F.col("start").isNull() | F.col("end").isNull())
    span = F.unix_micros("end_time") - F.unix_micros("start_time")
    bucket = (
        F.when(F.col("missing"), F.lit(None).cast("string"))
        .when(span <= DAY_US, F.lit("15 minutes"))
        .when(span <= 2 * DAY_US, F.lit("1 hour"))
        .when(span <= 30 * DAY_US, F.lit("1 day"))
        .when(span <= 365 * DAY_US, F.lit("1 week"))
    )
    return (
        requests.withColumn("start_time", start)
        .withColumn("end_time", end)
        .withColumn("missing", missing)
        .withColumn("bucket", bucket)
        .withColumn(
            "status",
            F.when(F.col("missing"), "missing_times")
            .when(F.col("bucket").isNull(), "invalid_range")
            .otherwise("ok"),
        )
        .drop("missing")
    )


def aggregate_windows(readings: DataFrame, metric_types: DataFrame, windows: DataFrame) -> DataFrame:
    """Buckets of distinct (user_id, metric_type, start_time, end_time, bucket) windows.

    A window is spread over the days it covers (366 at most, by the range rule)
    and joined on (metric, user, day). A user holding a large share of all
    readings is thereby cut by day, and on the stored table the join key holds
    both partition columns, so whole partitions are skipped at run time.
    """
    catalog = metric_types.select(F.col("name").alias("metric_type"), F.upper("agg").alias("agg"))
    days = windows.join(catalog, "metric_type").withColumn(
        "date",
        F.explode(
            F.when(
                F.col("start_time") <= F.col("end_time"),
                F.sequence(F.to_date("start_time"), F.to_date("end_time")),
            )
        ),
    )
    dated = readings if "date" in readings.columns else readings.withColumn("date", F.to_date("time"))
    keys = ["user_id", "metric_type", "start_time", "end_time", "bucket"]
    hits = dated.select("user_id", "metric_type", "date", "time", "value").join(
        days, ["user_id", "metric_type", "date"]
    )
    return (
        hits.filter(F.col("time").between(F.col("start_time"), F.col("end_time")))
        .groupBy(*keys, "agg", bucket_start(F.col("time"), bucket_width(F.col("bucket"))).alias("bucket_time"))
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        .select(
            *keys,
            "bucket_time",
            F.when(F.col("agg") == "SUM", F.col("total")).otherwise(F.col("total") / F.col("n")).alias("value"),
        )
    )


def chart_buckets(
    readings: DataFrame, metric_types: DataFrame, requests: DataFrame, perms: DataFrame, members: DataFrame
) -> DataFrame:
    """Chart points of every request that is valid and allowed.

    ``requests``: request_id, observer_id, user_id, metric_type, range, start, end, now.
    Requests for the same window share one aggregation.
    """
    planned = chart_plan(requests).filter(F.col("status") == "ok")
    verdicts = (
        check_access(planned.withColumnRenamed("user_id", "target_id"), perms, members)
        .filter(F.col("verdict") == "allowed")
        .withColumnRenamed("target_id", "user_id")
    )
    # Read for the windows and again for the answers: judged once.
    allowed = cut_lineage(planned.join(verdicts, ["observer_id", "user_id", "metric_type"], "left_semi"))
    keys = ["user_id", "metric_type", "start_time", "end_time", "bucket"]
    points = aggregate_windows(readings, metric_types, allowed.select(*keys).distinct())
    return allowed.select("request_id", *keys).join(points, keys).select(
        "request_id", "user_id", "metric_type", "bucket", "bucket_time", "value"
    )


def rollup_deltas(readings: DataFrame) -> DataFrame:
    """(sum, count) per user, metric, width and bucket: the form a live chart is kept in.

    Every bucket of a wider width is a union of 15-minute slots, so readings
    are folded to slots first and only slots are repeated per width.
    """
    slots = readings.groupBy(
        "user_id", "metric_type", bucket_start(F.col("time"), F.lit(WIDTHS["15 minutes"])).alias("slot")
    ).agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    return (
        slots.withColumn("bucket", F.explode(F.array(*[F.lit(w) for w in WIDTHS])))
        .withColumn("bucket_time", bucket_start(F.col("slot"), bucket_width(F.col("bucket"))))
        .groupBy("user_id", "metric_type", "bucket", "bucket_time")
        .agg(F.sum("s").alias("total"), F.sum("c").alias("n"))
    )


def read_rollup(rollup: DataFrame, metric_types: DataFrame) -> DataFrame:
    """Chart values out of (sum, count): the catalog says whether a metric is summed or averaged."""
    catalog = metric_types.select(F.col("name").alias("metric_type"), F.upper("agg").alias("agg"))
    return rollup.join(catalog, "metric_type").select(
        "user_id",
        "metric_type",
        "bucket",
        "bucket_time",
        F.when(F.col("agg") == "SUM", F.col("total")).otherwise(F.col("total") / F.col("n")).alias("value"),
    )


def hr_window_features(readings: DataFrame) -> DataFrame:
    """Mean and population deviation of heart rate per user and 60-second window."""
    return (
        readings.filter(F.col("metric_type") == "heart_rate")
        .groupBy("user_id", F.window("time", "60 seconds").alias("w"))
        .agg(F.avg("value").alias("hr_mean"), F.stddev_pop("value").alias("hr_std"))
        .select("user_id", F.col("w.start").alias("window_start"), "hr_mean", "hr_std")
    )
