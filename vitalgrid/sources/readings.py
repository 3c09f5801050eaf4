"""Readings in and out: message decoding, storing, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.skew import first_by
from vitalgrid.session import cut_lineage

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
# About 30 MB of a stored file.
ROWS_PER_SLICE = 2_000_000
READING_KEYS = ("user_id", "metric_type", "value", "timestamp")


def fold_key_case(message: Column, keys: tuple[str, ...] = READING_KEYS) -> Column:
    """Known keys in any letter case become lower case; text inside values keeps its escaped quotes and is not hit."""
    for key in keys:
        message = F.regexp_replace(message, rf'(?i)"{key}"(\s*:)', f'"{key}"$1')
    return message


def _field(key: str, kind: str) -> Column:
    return F.try_variant_get("__v", f"$.{key}", kind)


def _kind(key: str) -> Column:
    """JSON kind of a field: null when absent."""
    return F.schema_of_variant(F.try_variant_get("__v", f"$.{key}", "variant"))


def decode_readings(raw: DataFrame, message: str = "message") -> DataFrame:
    """Typed columns out of JSON messages, with ``reason`` set where decoding fails.

    Fields have strict kinds: a quoted number or an unquoted name is an error.
    An absent or null value counts as 0, absent names as ''.
    """
    parsed = raw.withColumn("__v", F.try_parse_json(fold_key_case(F.col(message))))
    top = F.schema_of_variant("__v")
    nothing = lambda k: _kind(k).isNull() | (_kind(k) == "VOID")
    is_text = lambda k: nothing(k) | (_kind(k) == "STRING")
    is_number = nothing("value") | _kind("value").rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*)$")
    stamp = _field("timestamp", "string")
    time = F.try_to_timestamp(F.upper(stamp))
    reason = (
        F.when(F.col("__v").isNull() | ~top.startswith("OBJECT"), "invalid_json")
        .when(~is_text("user_id") | ~is_text("metric_type") | ~is_number, "wrong_type")
        .when(~is_text("timestamp"), "bad_timestamp")
        .when(~nothing("timestamp") & (~stamp.rlike(RFC3339) | time.isNull()), "bad_timestamp")
    )
    return parsed.select(
        *raw.columns,
        F.coalesce(_field("user_id", "string"), F.lit("")).alias("user_id"),
        F.coalesce(_field("metric_type", "string"), F.lit("")).alias("metric_type"),
        F.coalesce(_field("value", "double"), F.lit(0.0)).alias("value"),
        F.when(stamp.rlike(RFC3339), time).alias("time"),
        reason.alias("reason"),
    )


def ingest_readings(raw: DataFrame, metric_types: DataFrame, users: DataFrame) -> DataFrame:
    """Decode and validate messages; ``reason`` is null for good rows.

    ``raw``: seq, message. A missing timestamp is quarantined; the storage path
    of a row-at-a-time consumer would keep such rows under year 1.
    """
    catalog = metric_types.select(F.col("name").alias("metric_type"), F.lit(True).alias("__metric"))
    people = users.select(F.col("id").cast("string").alias("user_id"), F.lit(True).alias("__user"))
    return (
        decode_readings(raw)
        .join(catalog, "metric_type", "left")
        .join(people, "user_id", "left")
        .select(
            *raw.columns,
            "user_id",
            "metric_type",
            "value",
            "time",
            F.coalesce(
                F.col("reason"),
                F.when(F.col("__metric").isNull(), "unknown_metric")
                .when(F.col("__user").isNull(), "unknown_user")
                .when(F.col("time").isNull(), "missing_timestamp"),
            ).alias("reason"),
        )
    )


def good_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull()).drop("reason")


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull())


def new_readings(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows of ``incoming`` that may be stored: the first per (metric, user, time), and none stored before.

    Only the (metric, date) partitions that incoming rows touch are read from
    the stored table, whatever the age of the readings.
    """
    keys = ["metric_type", "user_id", "time"]
    first = first_by(incoming, keys, [F.col("seq")]).withColumn("date", F.to_date("time"))
    if stored is None:
        return first
    touched = first.select("metric_type", "date").distinct()
    kept = stored.join(touched, ["metric_type", "date"], "left_semi").select(*keys, "date")
    return first.join(kept, [*keys, "date"], "left_anti")


def sliced(rows: DataFrame, per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``rows`` with ``slice``: as many slices per metric and day as the day's count needs, equally filled.

    The counts are one row per metric and day; user and time are hashed, so a
    user with most of a day's readings is spread over the day's slices.
    """
    days = rows.groupBy("metric_type", "date").agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias("__slices"))
    slot = F.pmod(F.xxhash64("user_id", "time"), F.col("__slices")).cast("int")
    return rows.join(days, ["metric_type", "date"]).withColumn("slice", slot).drop("__slices")


def store_readings(rows: DataFrame, path: str, mode: str = "append", per_slice: int = ROWS_PER_SLICE) -> None:
    """Write readings under metric, day and slice: a small day is one file, a busy one as many as its readings fill.

    ``rows`` are computed once: their counts and the files are read from a table.
    """
    (
        sliced(cut_lineage(rows), per_slice)
        .repartition("metric_type", "date", "slice")
        .write.mode(mode)
        .partitionBy("metric_type", "date", "slice")
        .parquet(path)
    )


def publish_readings(readings: DataFrame) -> DataFrame:
    """Key and JSON value per reading, the frame a topic sink takes."""
    stamp = F.concat(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"),
        F.regexp_replace(F.date_format("time", ".SSSSSS"), r"\.?0+$", ""),
        F.lit("Z"),
    )
    return readings.select(
        F.col("user_id").cast("string").alias("key"),
        F.to_json(
            F.struct(
                F.col("user_id").cast("string").alias("user_id"),
                "metric_type",
                F.col("value").cast("double").alias("value"),
                stamp.alias("timestamp"),
            )
        ).alias("value"),
    )


def push_guard(messages: DataFrame) -> DataFrame:
    """Class and verdict of client messages: client_id, viewer_id, message, arrived_at.

    control: has an action, and a non-empty item list whose items name a target
    and a metric; metric: has a user_id, which must be the sender's; a missing
    timestamp becomes the arrival time.
    """
    control_keys = ("action", "items", "target_user_id", "group_id")
    folded = messages.withColumn("__m", fold_key_case(fold_key_case(F.col("message")), control_keys))
    # the presence test reads the message as sent, so it is case-sensitive
    exact = folded.withColumn("__raw", F.try_parse_json("message"))
    has = lambda k: F.schema_of_variant(F.try_variant_get("__raw", f"$.{k}", "variant")).isNotNull()
    is_object = F.coalesce(F.schema_of_variant("__raw").startswith("OBJECT"), F.lit(False))
    kind = (
        F.when(~is_object, "invalid_json").when(has("action"), "control").when(has("user_id"), "metric").otherwise("unknown")
    )
    schema = "action string, items array<struct<target_user_id:string,metric_type:string,group_id:string>>"
    control = F.from_json("__m", schema)
    items = F.col("__control.items")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    bad_item = F.exists(items, lambda i: blank(i["target_user_id"]) | blank(i["metric_type"]))
    decoded = decode_readings(exact.withColumn("kind", kind).withColumn("__control", control))
    verdict = (
        F.when(F.col("kind") == "invalid_json", "invalid_json")
        .when(F.col("kind") == "unknown", "unknown_structure")
        .when(
            F.col("kind") == "control",
            F.when(
                blank(F.col("__control.action")) | items.isNull() | (F.size(items) < 1) | bad_item, "invalid_control"
            ).otherwise("accepted"),
        )
        .when(F.col("reason").isNotNull(), "invalid_metric")
        .when(F.col("user_id") != F.col("viewer_id").cast("string"), "forbidden")
        .otherwise("accepted")
    )
    is_metric = F.col("kind") == "metric"
    return decoded.select(
        *messages.columns,
        "kind",
        verdict.alias("verdict"),
        F.when(F.col("kind") == "control", F.col("__control.action")).alias("action"),
        F.when(F.col("kind") == "control", items).alias("items"),
        F.when(is_metric, F.col("user_id")).alias("user_id"),
        F.when(is_metric, F.col("metric_type")).alias("metric_type"),
        F.when(is_metric, F.col("value")).alias("value"),
        F.when(is_metric, F.coalesce("time", "arrived_at")).alias("time"),
    )
