"""Medication reminders: due, missed, taken, shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.skew import first_by, last_by
from vitalgrid.functions.zones import known_zone, local_date, local_time, zone_or_utc

HH_MM = r"^([01]?\d|2[0-3]):[0-5]\d$"
DEFAULT_TIME = "08:00"
DEFAULT_OFFSET = 15


def reminder_ticks(spark, start: str, end: str) -> DataFrame:
    """One tick per minute from start to end, both included."""
    seq = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr("interval 1 minute"))
    return spark.range(1).select(F.explode(seq).alias("tick"))


def due_reminders(reminders: DataFrame, medications: DataFrame, users: DataFrame, ticks: DataFrame) -> DataFrame:
    """Enabled reminders of active medications whose local HH:MM equals a tick's, within the dates.

    Ticks are turned into local clock readings of each zone in use, so the match
    is an equi join on (zone, HH:MM). Users without a usable zone are left out.
    """
    zoned = users.select(F.col("id").alias("user_id"), known_zone(F.col("timezone")).alias("zone")).filter(
        F.col("zone").isNotNull()
    )
    # at most the ~600 public zones
    zones = zoned.agg(F.collect_set("zone")).scalar()
    clock = ticks.select("tick", F.explode(zones).alias("zone")).select(
        "tick",
        "zone",
        F.date_format(local_time(F.col("tick"), F.col("zone")), "HH:mm").alias("time"),
        local_date(F.col("tick"), F.col("zone")).alias("today"),
    )
    candidates = (
        reminders.filter("is_enabled")
        .select(F.col("id").alias("reminder_id"), "medication_id", "time")
        .join(
            medications.filter("is_active").select(
                F.col("id").alias("medication_id"), "user_id", "start_date", "end_date"
            ),
            "medication_id",
        )
        .join(zoned, "user_id")
    )
    # everybody in one zone may be reminded at one time of day: such keys are split at run time
    return (
        clock.join(candidates, ["zone", "time"])
        .filter(F.col("today") >= F.col("start_date"))
        .filter(F.col("end_date").isNull() | (F.col("today") <= F.col("end_date")))
        .select("tick", "reminder_id", "medication_id", "user_id", "time")
    )


def missed_reminders(
    shares: DataFrame, medications: DataFrame, reminders: DataFrame, users: DataFrame, now: str
) -> DataFrame:
    """Share x reminder rows whose time plus offset has passed today without a take.

    The start and end dates are compared as UTC midnights, unlike in
    ``due_reminders``. A share already marked for the same reminder stays out
    when its date is today's or unknown.
    """
    at = F.lit(now).cast("timestamp")
    zone = zone_or_utc(F.col("timezone"))
    joined = (
        shares.select(
            F.col("id").alias("share_id"), "medication_id", "shared_with_user_id", "notify_offset_minutes",
            "last_notified_reminder_id", "last_notified_date",
        )
        .join(
            medications.filter("is_active").select(
                F.col("id").alias("medication_id"), F.col("name").alias("medication_name"),
                F.col("user_id").alias("owner_id"), "start_date", "end_date",
            ),
            "medication_id",
        )
        .filter(at >= F.col("start_date").cast("timestamp"))
        .filter(F.col("end_date").isNull() | (at <= F.date_add("end_date", 1).cast("timestamp")))
        .join(users.select(F.col("id").alias("owner_id"), zone.alias("zone")), "owner_id")
        .withColumn("today", local_date(at, F.col("zone")))
        .join(
            reminders.filter("is_enabled").select(
                F.col("id").alias("reminder_id"), "medication_id", F.col("time").alias("reminder_time"), "last_taken"
            ),
            "medication_id",
        )
    )
    not_marked = (
        F.col("last_notified_reminder_id").isNull()
        | (F.col("last_notified_reminder_id") != F.col("reminder_id"))
        | (F.col("last_notified_date") != F.col("today"))
    )
    taken_today = local_date(F.col("last_taken"), F.col("zone")) == F.col("today")
    local_due = F.when(
        F.col("reminder_time").rlike(HH_MM),
        F.try_to_timestamp(
            F.concat_ws(" ", F.col("today").cast("string"), F.lpad("reminder_time", 5, "0")), F.lit("yyyy-MM-dd HH:mm")
        ),
    )
    notify_at = F.timestamp_micros(
        F.unix_micros(F.to_utc_timestamp(local_due, F.col("zone")))
        + F.col("notify_offset_minutes").cast("bigint") * F.lit(60_000_000)
    )
    return (
        joined.filter(not_marked)
        .filter(~F.coalesce(taken_today, F.lit(False)))
        .filter(at > notify_at)
        .select(
            "share_id", "medication_id", "medication_name", "reminder_id", "reminder_time", "owner_id",
            "shared_with_user_id", "notify_offset_minutes", "zone", "today",
        )
    )


def missed_state(shares: DataFrame, sent: DataFrame) -> DataFrame:
    """Shares after marking what was sent: one mark per share, the highest reminder id when several went out."""
    marks = sent.groupBy(F.col("share_id").alias("id")).agg(
        F.max_by(F.struct("reminder_id", "today"), "reminder_id").alias("mark")
    )
    return shares.join(marks, "id", "left").select(
        *[
            F.coalesce(f"mark.{new}", c).alias(c) if (new := NEW_MARK.get(c)) else F.col(c)
            for c in shares.columns
        ]
    )


NEW_MARK = {"last_notified_reminder_id": "reminder_id", "last_notified_date": "today"}


def reminder_messages(due: DataFrame, missed: DataFrame) -> DataFrame:
    """Messages for due reminders (owner) and missed ones (owner and buddy)."""
    text = lambda c: F.col(c).cast("string")
    reminded = due.select(
        F.col("user_id").alias("recipient_id"),
        F.lit("Medication Reminder").alias("title"),
        F.lit("It's time for your medication.").alias("body"),
        F.create_map(
            F.lit("type"), F.lit("MEDICATION_REMINDER"),
            F.lit("reminder_id"), text("reminder_id"),
            F.lit("medication_id"), text("medication_id"),
            F.lit("time"), F.col("time"),
            F.lit("timestamp"), F.unix_seconds("tick").cast("string"),
        ).alias("data"),
    )
    to_owner = missed.select(
        F.col("owner_id").alias("recipient_id"),
        F.lit("Missed Medication!").alias("title"),
        F.format_string(
            "You missed your medication: %s at %s. Please take it now.", "medication_name", "reminder_time"
        ).alias("body"),
        F.create_map(
            F.lit("type"), F.lit("MEDICATION_MISSED_OWNER"),
            F.lit("medication_id"), text("medication_id"),
            F.lit("reminder_id"), text("reminder_id"),
        ).alias("data"),
    )
    to_buddy = missed.select(
        F.col("shared_with_user_id").alias("recipient_id"),
        F.lit("Medication Alert!").alias("title"),
        F.format_string("Your buddy missed their medication: %s at %s.", "medication_name", "reminder_time").alias(
            "body"
        ),
        F.create_map(
            F.lit("type"), F.lit("MEDICATION_MISSED_BUDDY"),
            F.lit("medication_id"), text("medication_id"),
            F.lit("reminder_id"), text("reminder_id"),
            F.lit("owner_id"), text("owner_id"),
        ).alias("data"),
    )
    return reminded.unionByName(to_owner).unionByName(to_buddy)


def toggle_takes(reminders: DataFrame, medications: DataFrame, takes: DataFrame, users: DataFrame) -> DataFrame:
    """Reminders after take events, which flip today's take on and off.

    ``takes``: medication_id, reminder_id, user_id, ts, in time order and not
    before the stored last_taken. Only the owner's count. On the last local day
    with takes an odd number of flips leaves the latest one, an even number
    leaves none; a take already stored on that day is the first flip. Earlier
    days leave no trace, so a pair of aggregates replaces the replay.
    """
    owners = medications.select(F.col("id").alias("medication_id"), "user_id")
    zones = users.select(F.col("id").alias("user_id"), zone_or_utc(F.col("timezone")).alias("zone"))
    known = reminders.select(F.col("id").alias("reminder_id"), "medication_id", "last_taken")
    flips = (
        takes.join(owners, ["medication_id", "user_id"])
        .join(zones, "user_id")
        .withColumn("day", local_date(F.col("ts"), F.col("zone")))
        .groupBy("reminder_id", "medication_id", "zone", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        .groupBy("reminder_id", "medication_id", "zone")
        .agg(F.max_by(F.struct("day", "n", "last"), "day").alias("f"))
    )
    decided = known.join(flips, ["reminder_id", "medication_id"]).select(
        F.col("reminder_id").alias("id"),
        F.struct(
            F.when(
                F.pmod(
                    F.col("f.n")
                    + F.when(local_date(F.col("last_taken"), F.col("zone")) == F.col("f.day"), 1).otherwise(0),
                    F.lit(2),
                )
                == 1,
                F.col("f.last"),
            ).alias("taken")
        ).alias("new"),
    )
    return reminders.join(decided, "id", "left").select(
        *[
            F.when(F.col("new").isNotNull(), F.col("new.taken")).otherwise(F.col(c)).alias(c)
            if c == "last_taken"
            else F.col(c)
            for c in reminders.columns
        ]
    )


def take_verdicts(takes: DataFrame, medications: DataFrame, reminders: DataFrame) -> DataFrame:
    """ok, not_found or forbidden per take event."""
    owners = medications.select(F.col("id").alias("medication_id"), F.col("user_id").alias("owner_id"))
    known = reminders.select(F.col("id").alias("reminder_id"), "medication_id", F.lit(True).alias("known"))
    return (
        takes.join(owners, "medication_id", "left")
        .join(known, ["reminder_id", "medication_id"], "left")
        .withColumn(
            "verdict",
            F.when(F.col("owner_id").isNull(), "not_found")
            .when(F.col("owner_id") != F.col("user_id"), "forbidden")
            .when(F.col("known").isNull(), "not_found")
            .otherwise("ok"),
        )
        .select(*takes.columns, "verdict")
    )


def medication_shares_of(shares: DataFrame, medications: DataFrame, requests: DataFrame) -> DataFrame:
    """Shares of a medication for its owner, one 'forbidden' row for anybody else.

    ``requests``: request_id, user_id, medication_id.
    """
    owned = medications.select(F.col("id").alias("medication_id"), "user_id", F.lit(True).alias("own"))
    judged = requests.join(owned, ["medication_id", "user_id"], "left")
    granted = judged.filter("own").join(
        shares.select("medication_id", F.col("id").alias("share_id"), "shared_with_user_id", "notify_offset_minutes"),
        "medication_id",
        "left",
    )
    cols = ["request_id", "medication_id", "verdict", "share_id", "shared_with_user_id", "notify_offset_minutes"]
    refused = judged.filter(F.col("own").isNull()).withColumn("verdict", F.lit("forbidden"))
    for c in cols[3:]:
        refused = refused.withColumn(c, F.lit(None).cast(shares.schema["id" if c == "share_id" else c].dataType))
    return granted.withColumn("verdict", F.lit("ok")).select(cols).unionByName(refused.select(cols))


def medications_nested(medications: DataFrame, reminders: DataFrame, shares: DataFrame, users: DataFrame) -> DataFrame:
    """One row per medication with reminders (by time), shares and the user's zone."""
    reminder_cols = [c for c in reminders.columns if c not in ("medication_id", "time", "id")]
    share_cols = [c for c in shares.columns if c not in ("medication_id", "id")]
    per_med = reminders.groupBy(F.col("medication_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("time", F.col("id").alias("reminder_id"), *reminder_cols))).alias("reminders")
    )
    shared = shares.groupBy(F.col("medication_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("id").alias("share_id"), *share_cols))).alias("shares")
    )
    empty = lambda c, frame: F.coalesce(F.col(c), F.array().cast(frame.schema[c].dataType)).alias(c)
    return (
        medications.join(users.select(F.col("id").alias("user_id"), "timezone"), "user_id")
        .join(per_med, "id", "left")
        .join(shared, "id", "left")
        .select(*medications.columns, "timezone", empty("reminders", per_med), empty("shares", shared))
    )


def latest_timezone(medications: DataFrame, users: DataFrame) -> DataFrame:
    """Users with the zone of their newest medication, where one exists."""
    newest = medications.groupBy(F.col("user_id").alias("id")).agg(
        F.max_by("timezone", F.struct("created_at", "id")).alias("__zone"), F.lit(True).alias("__has")
    )
    return users.join(newest, "id", "left").select(
        *[
            F.when(F.col("__has"), F.col("__zone")).otherwise(F.col(c)).alias(c) if c == "timezone" else F.col(c)
            for c in users.columns
        ]
    )


REQUEST_BODY = (
    "name string, dosage string, frequency string, start_date string, instructions string, prescribed_by string, "
    "is_active boolean, reminders array<struct<time:string,is_enabled:boolean>>, "
    "shares array<struct<group_id:bigint,shared_with_user_id:bigint,notify_offset_minutes:int>>"
)


def apply_medications(requests: DataFrame, today: str) -> dict[str, DataFrame]:
    """Rows created by medication requests: id, user_id, body (JSON).

    Defaults: active, an unreadable start date means today, no reminders mean
    one at 08:00, a blank time is 08:00, reminders are enabled. Offsets of
    initial shares are kept as given.
    """
    body = requests.withColumn("b", F.from_json("body", REQUEST_BODY))
    strict_date = F.when(
        F.col("b.start_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("b.start_date", "yyyy-MM-dd")
    )
    medications = body.select(
        "id",
        "user_id",
        "b.name",
        "b.dosage",
        F.coalesce("b.instructions", F.lit("")).alias("instructions"),
        F.coalesce("b.prescribed_by", F.lit("")).alias("prescribed_by"),
        F.coalesce("b.is_active", F.lit(True)).alias("is_active"),
        "b.frequency",
        F.coalesce(strict_date, F.lit(today).cast("date")).alias("start_date"),
    )
    default = F.array(F.struct(F.lit(DEFAULT_TIME).alias("time"), F.lit(True).alias("is_enabled")))
    given = F.col("b.reminders")
    reminders = body.select(
        F.col("id").alias("medication_id"),
        F.posexplode(F.when(given.isNull() | (F.size(given) == 0), default).otherwise(given)).alias("pos", "r"),
    ).select(
        "medication_id",
        "pos",
        F.when(F.coalesce("r.time", F.lit("")) == "", DEFAULT_TIME).otherwise(F.col("r.time")).alias("time"),
        F.coalesce("r.is_enabled", F.lit(True)).alias("is_enabled"),
    )
    shares = body.select(F.col("id").alias("medication_id"), F.posexplode("b.shares").alias("pos", "s")).select(
        "medication_id",
        "pos",
        "s.group_id",
        "s.shared_with_user_id",
        F.coalesce("s.notify_offset_minutes", F.lit(0)).alias("notify_offset_minutes"),
    )
    return {"medications": medications, "reminders": reminders, "shares": shares}


def apply_shares(shares: DataFrame, medications: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Share table after one round of requests, and a verdict per request.

    ``requests``: seq, op ('add' or 'delete'), user_id, medication_id, share_id,
    group_id, shared_with_user_id, notify_offset_minutes. Deletes act on the
    table before the round and need the medication's owner; adds follow, check
    no owner, default offsets below 1 to 15, and the first per (medication,
    viewer) wins.
    """
    owners = medications.select(F.col("id").alias("medication_id"), F.col("user_id").alias("owner_id"))
    existing = shares.select(F.col("id").alias("share_id"), "medication_id", F.lit(True).alias("found"))
    deletes = (
        requests.filter(F.col("op") == "delete")
        .join(owners, "medication_id", "left")
        .join(existing, ["share_id", "medication_id"], "left")
        .withColumn(
            "verdict",
            F.when(F.col("owner_id").isNull(), "not_found")
            .when(F.col("owner_id") != F.col("user_id"), "forbidden")
            .when(F.col("found").isNull(), "not_found")
            .otherwise("deleted"),
        )
    )
    gone = deletes.filter(F.col("verdict") == "deleted").select(F.col("share_id").alias("id")).distinct()
    kept = shares.join(gone, "id", "left_anti")
    adds = requests.filter(F.col("op") == "add").withColumn(
        "notify_offset_minutes",
        F.when(F.coalesce("notify_offset_minutes", F.lit(0)) <= 0, DEFAULT_OFFSET).otherwise(
            F.col("notify_offset_minutes")
        ).cast("int"),
    )
    pair = ["medication_id", "shared_with_user_id"]
    fresh = first_by(
        adds.select("seq", F.col("share_id").alias("id"), *pair, "group_id", "notify_offset_minutes"), pair, [F.col("seq")]
    ).join(kept.select(*pair), pair, "left_anti")
    table = kept.unionByName(fresh.drop("seq"), allowMissingColumns=True)
    added = fresh.select("seq", F.lit(True).alias("won"))
    verdicts = deletes.select("seq", "op", "verdict").unionByName(
        adds.join(added, "seq", "left").select(
            "seq", "op", F.when(F.col("won"), "added").otherwise("already_shared").alias("verdict")
        )
    )
    return table, verdicts


def delete_medications(
    medications: DataFrame, reminders: DataFrame, shares: DataFrame, deletes: DataFrame
) -> dict[str, DataFrame]:
    """Tables after owners deleted medications: (medication_id, user_id); reminders and shares go along."""
    gone = (
        deletes.select("medication_id", "user_id")
        .join(medications.select(F.col("id").alias("medication_id"), "user_id"), ["medication_id", "user_id"], "left_semi")
        .select("medication_id")
        .distinct()
    )
    return {
        "medications": medications.join(gone.withColumnRenamed("medication_id", "id"), "id", "left_anti").select(
            medications.columns
        ),
        "reminders": reminders.join(gone, "medication_id", "left_anti").select(reminders.columns),
        "shares": shares.join(gone, "medication_id", "left_anti").select(shares.columns),
    }
