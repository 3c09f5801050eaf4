"""Users, groups and memberships: rosters, invitations, searches, look-ups, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 100
DEFAULT_PAGE = 10
MAX_ALLERGIES = 50
MAX_ALLERGY_CHARS = 100
OPEN_STATES = ("pending", "pending_owner_approval")


def display_name(name: Column, email: Column) -> Column:
    """Trimmed name, else the local part of the e-mail, else ''."""
    local = F.split_part(F.coalesce(email, F.lit("")), F.lit("@"), F.lit(1))
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(local, F.lit("")), F.lit(""))


def member_display(members: DataFrame, users: DataFrame, only_accepted: bool = True) -> DataFrame:
    """Memberships with display names: a roster (accepted only) or single members of any status."""
    rows = members.filter(F.col("status") == "accepted") if only_accepted else members
    people = users.select(
        F.col("id").alias("user_id"),
        display_name(F.col("name"), F.col("email")).alias("name"),
        F.coalesce("email", F.lit("")).alias("email"),
    )
    return rows.join(people, "user_id").select(*members.columns, "name", "email")


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def page_size(limit: int) -> int:
    return DEFAULT_PAGE if limit <= 0 else min(limit, MAX_PAGE)


def search_users(users: DataFrame, status: str = "", search: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """Newest users first; status by equality, search text anywhere in name or e-mail (% and _ are wildcards)."""
    out = users
    if status:
        out = out.filter(F.col("status") == status)
    if search:
        pattern = f"%{search}%"
        out = out.filter(F.col("name").ilike(pattern) | F.col("email").ilike(pattern))
    return _page(out, page_size(limit), offset)


def search_groups(groups: DataFrame, owner=None, search: str = "", limit: int = 10, offset: int = 0) -> DataFrame:
    out = groups
    if owner is not None:
        out = out.filter(F.col("owner_id") == owner)
    if search:
        out = out.filter(F.col("name").ilike(f"%{search}%"))
    return _page(out, limit, offset)


def groups_of_user(groups: DataFrame, members: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Accepted memberships, newest group first, one page per user.

    The rank limit is applied before the shuffle too, so a user in very many
    groups sends at most a page from each task.
    """
    joined = members.filter(F.col("status") == "accepted").select("group_id", "user_id").join(
        groups.withColumnRenamed("id", "group_id"), "group_id"
    )
    return _page_per(joined, "user_id", "group_id", limit, offset)


def groups_of_owner(groups: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return _page_per(groups.withColumnRenamed("id", "group_id"), "owner_id", "group_id", limit, offset)


def _page_per(df: DataFrame, key: str, tie: str, limit: int, offset: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), tie)
    return df.withColumn("position", F.row_number().over(w)).filter(
        (F.col("position") <= offset + limit) & (F.col("position") > offset)
    )


def bulk_exists(keys: DataFrame, table: DataFrame, on: dict[str, str], flag: str = "found") -> DataFrame:
    """Add ``flag``: does ``table`` hold the key? ``on`` maps key columns to table columns."""
    right = table.select(*[F.col(t).alias(k) for k, t in on.items()]).distinct().withColumn(flag, F.lit(True))
    return keys.join(right, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def bulk_lookup(keys: DataFrame, table: DataFrame, on: dict[str, str], get: dict[str, str]) -> DataFrame:
    """Left look-up of ``get`` columns (new name -> table column); ``found`` says if a row was there."""
    right = table.select(
        *[F.col(t).alias(k) for k, t in on.items()], *[F.col(t).alias(n) for n, t in get.items()], F.lit(True).alias("found")
    )
    return keys.join(right, list(on), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def user_names(keys: DataFrame, users: DataFrame) -> DataFrame:
    """user_id -> name, 'Unknown User' when there is no such user."""
    looked = bulk_lookup(keys, users, {"user_id": "id"}, {"name": "name"})
    return looked.select("user_id", F.when(F.col("found"), F.col("name")).otherwise(F.lit("Unknown User")).alias("name"))


def group_name_check(groups: DataFrame) -> DataFrame:
    """ok, bad_length (3 to 100 bytes) or duplicate (per owner) for each group."""
    repeated = groups.groupBy("owner_id", "name").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    size = F.octet_length("name")
    return groups.join(repeated, ["owner_id", "name"], "left").select(
        *groups.columns,
        F.when(~size.between(3, 100), "bad_length").when(F.col("repeated"), "duplicate").otherwise("ok").alias("verdict"),
    )


def cleaned_allergies(raw: Column) -> Column:
    """Trimmed, non-blank, at most 100 characters each, first of each spelling regardless of case."""
    items = F.filter(
        F.transform(raw, lambda a: F.substring(F.trim(a), 1, MAX_ALLERGY_CHARS)), lambda a: a != ""
    )
    lowered = F.transform(items, lambda a: F.lower(a))
    return F.filter(items, lambda a, i: F.array_position(lowered, F.lower(a)) == i + 1)


def clean_allergies(users: DataFrame) -> DataFrame:
    """id, allergies and whether the list is accepted (at most 50 entries)."""
    cleaned = F.coalesce(cleaned_allergies(F.col("allergies")), F.array().cast("array<string>"))
    return users.select("id", cleaned.alias("allergies")).withColumn("accepted", F.size("allergies") <= MAX_ALLERGIES)


def birthday_date(text: Column) -> Column:
    """Date of an RFC 3339 instant (its own calendar day) or a plain date, else null."""
    stamp = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    readable = text.rlike(r"^\d{4}-\d{2}-\d{2}$") | (text.rlike(stamp) & F.try_to_timestamp(text).isNotNull())
    return F.when(readable, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


OPTIONAL_TEXT = ["picture", "google_id", "password", "phone", "address", "gender", "blood_group", "timezone"]


def normalize_profiles(rows: DataFrame) -> DataFrame:
    """Blank text and zero sizes become null, birthdays dates, missing allergy lists empty ones."""
    out = rows
    for c in OPTIONAL_TEXT:
        if c in rows.columns:
            out = out.withColumn(c, F.nullif(F.col(c), F.lit("")))
    for c in ("weight", "height"):
        if c in rows.columns:
            out = out.withColumn(c, F.when(F.col(c) != 0, F.col(c)))
    if "birthday" in rows.columns:
        out = out.withColumn("birthday", birthday_date(F.col("birthday")))
    if "allergies" in rows.columns:
        out = out.withColumn("allergies", F.coalesce("allergies", F.array().cast("array<string>")))
    return out


def group_sizes(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Accepted and all members per group; a group may be deleted while it holds one member at most."""
    counts = members.groupBy(F.col("group_id").alias("id")).agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count(F.lit(1)).alias("members")
    )
    return groups.join(counts, "id", "left").select(
        "id",
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.coalesce("members", F.lit(0)).alias("members"),
        (F.coalesce("members", F.lit(0)) <= 1).alias("may_delete"),
    )


def user_invitations(members: DataFrame, groups: DataFrame, users: DataFrame) -> DataFrame:
    """Pending invitations with group, inviter and invitee, and the group's accepted count."""
    counts = (
        members.filter(F.col("status") == "accepted")
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("member_count"))
    )
    person = lambda key: users.select(
        F.col("id").alias(key), F.struct("id", "name", "email").alias(f"{key}_info")
    )
    return (
        members.filter(F.col("status") == "pending")
        .join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id")
        .join(counts, "group_id", "left")
        .join(person("invited_by"), "invited_by")
        .join(person("user_id"), "user_id")
        .select(
            F.col("group_id").alias("id"),
            F.col("created_at").alias("sent_at"),
            F.struct(
                F.col("group_id").alias("id"),
                F.col("group_name").alias("name"),
                F.coalesce("member_count", F.lit(0)).alias("member_count"),
            ).alias("group"),
            F.col("invited_by_info").alias("inviter"),
            F.col("user_id_info").alias("invite_to"),
        )
    )


def _open_invitations(members: DataFrame, users: DataFrame, states: tuple[str, ...]) -> DataFrame:
    return (
        members.filter(F.col("status").isin(*states))
        .join(
            users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"), F.col("name").alias("user_name")),
            "user_id",
        )
        .join(users.select(F.col("id").alias("invited_by"), F.col("name").alias("inviter_name")), "invited_by")
        .select("group_id", "user_id", "user_email", "user_name", "invited_by", "inviter_name", "status", "created_at")
    )


def _roles(requesters: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """requesters (request_id, group_id, requester_id) with group_found, is_owner and is_accepted."""
    owners = groups.select(F.col("id").alias("group_id"), "owner_id")
    joined = members.filter(F.col("status") == "accepted").select(
        "group_id", F.col("user_id").alias("requester_id"), F.lit(True).alias("is_accepted")
    )
    return (
        requesters.join(owners, "group_id", "left")
        .join(joined, ["group_id", "requester_id"], "left")
        .withColumn("group_found", F.col("owner_id").isNotNull())
        .withColumn("is_owner", F.coalesce(F.col("owner_id") == F.col("requester_id"), F.lit(False)))
        .withColumn("is_accepted", F.coalesce("is_accepted", F.lit(False)))
        .drop("owner_id")
    )


def group_invitations(members: DataFrame, users: DataFrame, groups: DataFrame, requesters: DataFrame) -> DataFrame:
    """Open invitations per request: an accepted owner sees all, an accepted member those they sent."""
    roles = _roles(requesters, groups, members).filter(F.col("group_found") & F.col("is_accepted"))
    rows = _open_invitations(members, users, OPEN_STATES)
    return (
        roles.join(rows, "group_id")
        .filter(F.col("is_owner") | (F.col("invited_by") == F.col("requester_id")))
        .select("request_id", "requester_id", *rows.columns)
    )


def invitation_verdicts(members: DataFrame, groups: DataFrame, requesters: DataFrame) -> DataFrame:
    """Why a request for invitations is refused, or ok."""
    return _roles(requesters, groups, members).select(
        "request_id",
        F.when(~F.col("group_found"), "invalid_group").when(~F.col("is_accepted"), "not_member").otherwise("ok").alias("verdict"),
    )


def pending_approvals(members: DataFrame, users: DataFrame, groups: DataFrame, requesters: DataFrame) -> DataFrame:
    """Members waiting for approval, for requests by the group's owner."""
    owners = _roles(requesters, groups, members).filter("is_owner")
    rows = _open_invitations(members, users, ("pending_owner_approval",))
    return owners.join(rows, "group_id").select("request_id", "requester_id", *rows.columns)


PATCHABLE = [
    "name", "picture", "phone", "address", "gender", "birthday", "weight", "height", "blood_group", "timezone", "allergies",
]


def apply_profile_patches(users: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users after patches in order of seq, and a verdict per patch.

    Null fields leave the value, a birthday of '' clears it. A patch without
    any field, or with more than 50 allergies, is refused as a whole. The fold
    is the last non-null value per field, an aggregate.
    """
    fields = [c for c in PATCHABLE if c in patches.columns]
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in fields], F.lit(False))
    judged = patches.withColumn("allergies", cleaned_allergies(F.col("allergies"))) if "allergies" in fields else patches
    too_many = F.coalesce(F.size("allergies") > MAX_ALLERGIES, F.lit(False)) if "allergies" in fields else F.lit(False)
    known = users.select(F.col("id"), F.lit(True).alias("__known"))
    judged = judged.join(known, "id", "left").withColumn(
        "verdict",
        F.when(~some | too_many, "invalid_request").when(F.col("__known").isNull(), "not_found").otherwise("ok"),
    )
    last = (
        judged.filter(F.col("verdict") == "ok")
        .groupBy("id")
        .agg(
            F.struct(
                *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
            ).alias("p")
        )
    )
    joined = users.join(last, "id", "left")

    def value(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        new = F.col(f"p.{c}")
        if c == "birthday":
            return F.when(new.isNull(), F.col(c)).when(new != "", birthday_date(new)).alias(c)
        return F.coalesce(new, F.col(c)).alias(c)

    return joined.select(*[value(c) for c in users.columns]), judged.select("seq", "id", "verdict")
