"""Scanned text before parsing: reading order, choice and merging of passes, mark-up, personal data.

Functions on whole documents work inside the row, on the array of its lines, so
they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import rx_fixed as fx
from vitalgrid.functions import rx_text as tx
from vitalgrid.functions.skew import first_by

LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def text_lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), lambda s: tx.strip(s)), lambda s: s != "")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Text of a page from boxes (doc_id, box_no, points, text, conf): top to bottom by mean y, mean confidence."""
    ys = F.transform("points", lambda p: F.get(p, F.lit(1)).cast("double"))
    mean_y = F.coalesce(F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.nullif(F.size(ys), F.lit(0)), F.lit(0.0))
    used = boxes.withColumn("text", tx.strip("text")).filter(F.col("text") != "")
    return (
        used.groupBy("doc_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(mean_y.alias("y"), "box_no", "text"))).alias("rows"),
            F.avg(F.coalesce("conf", F.lit(0.0))).alias("confidence"),
        )
        .select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"), "confidence")
    )


def _pass_order(name: Column) -> Column:
    order = F.lit(len(fx.PASS_ORDER))
    for i, known in enumerate(fx.PASS_ORDER):
        order = F.when(name == known, F.lit(i)).otherwise(order)
    return order


def best_pass(passes: DataFrame) -> DataFrame:
    """Best of (doc_id, pass, conf, text): confidence plus length credit; the earlier pass among equals."""
    quality = F.col("conf") + F.least(F.length("text"), F.lit(1500)) / F.lit(4000.0)
    rank = F.struct(F.col("quality"), -_pass_order(F.col("pass")))
    return (
        passes.withColumn("quality", quality)
        .groupBy("doc_id")
        .agg(F.max_by(F.struct("pass", "conf", "text", "quality"), rank).alias("b"))
        .select("doc_id", "b.*")
    )


def fold_key(line: Column) -> Column:
    """Key under which common misreadings (l, 1 and I; 0 and O; rn and m) agree."""
    s = F.lower(tx.one_line(line))
    s = F.regexp_replace(s, "[l1]", "i")
    return F.replace(F.replace(s, F.lit("0"), F.lit("o")), F.lit("rn"), F.lit("m"))


def genuine_signal(line: Column) -> Column:
    found = tx.has_signal(F.lower(line)) | tx.matches(line, fx.SCAN_SIGNAL) | tx.matches(line, fx.SUPPLY_COUNT)
    return found & tx.matches(line, f"[{fx.LETTER}]{{5,}}", tx.EXACT)


def merge_passes(lines: DataFrame, base: DataFrame) -> DataFrame:
    """Lines of the base pass, then lines of other passes that mention a medicine and are new.

    ``lines``: doc_id, pass, line_no, line; ``base``: doc_id, pass. Result:
    doc_id, pos, line.
    """
    keyed = lines.join(base.select("doc_id", F.col("pass").alias("base_pass")), "doc_id").select(
        "doc_id",
        (F.col("pass") != F.col("base_pass")).alias("extra"),
        _pass_order(F.col("pass")).alias("pass_no"),
        "line_no",
        tx.strip("line").alias("line"),
        fold_key(F.col("line")).alias("key"),
        F.lower(tx.one_line(F.col("line"))).alias("norm"),
    )
    own = keyed.filter(~F.col("extra"))
    others = keyed.filter(F.col("extra") & (F.col("norm") != "") & genuine_signal(F.col("line"))).join(
        own.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti"
    )
    order = [F.col("extra"), F.col("pass_no"), F.col("line_no")]
    merged = own.unionByName(first_by(others, ["doc_id", "key"], order)).filter(F.length("norm") >= 2)
    unique = first_by(merged, ["doc_id", "norm"], order)
    return (
        unique.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("extra", "pass_no", "line_no", "line"))).alias("rows"))
        .select("doc_id", F.posexplode(F.transform("rows", lambda r: r["line"])).alias("pos", "line"))
    )


def choose_text(docs: DataFrame) -> DataFrame:
    """Primary text, or a longer secondary one when the primary is empty, short or of low score."""
    primary, secondary = F.coalesce("primary_text", F.lit("")), F.coalesce("secondary_text", F.lit(""))
    weak = (F.length(primary) < 120) | (F.col("score") < 0.45)
    take = weak & (F.length(secondary) > F.length(primary))
    return docs.select(
        "doc_id",
        F.when(take, secondary).otherwise(primary).alias("text"),
        F.when(take, F.greatest("score", F.lit(0.5))).otherwise(F.col("score")).alias("score"),
        take.alias("used_fallback"),
    )


def clean_markdown(docs: DataFrame) -> DataFrame:
    """Mark-up removed; after the prescription header all lines stay, before it dosing and numbered ones."""
    lines = text_lines(F.coalesce("text", F.lit("")))

    def bare(line: Column) -> Column:
        s = tx.replace(line, r"^[#>\-\*\s]+", "", tx.EXACT)
        s = F.replace(tx.replace(s, r"\*\*(.*?)\*\*", "$1", tx.EXACT), F.lit("|"), F.lit(" "))
        return F.regexp_replace(tx.replace(s, r"\s+", " ", tx.EXACT), r"^[ \-:;]+|[ \-:;]+$", "")

    header = lambda s: tx.matches(s, fx.PRESCRIPTION_HEADER)
    frame = docs.select("doc_id", lines.alias("lines")).withColumn(
        "bare", F.filter(F.transform("lines", bare), lambda s: s != "")
    )
    frame = frame.withColumn("head", F.array_position(F.transform("bare", header), True))
    kept = F.filter(
        "bare",
        lambda s, i: header(s)
        | (
            ~tx.matches(s, fx.NOISE_LINE)
            & (((F.col("head") > 0) & (i + 1 > F.col("head"))) | tx.matches(s, fx.ITEM_LINE))
        ),
    )
    plain = F.transform("lines", lambda s: tx.one_line(s))
    return frame.withColumn("kept", kept).select(
        "doc_id",
        tx.strip(F.array_join(F.when(F.size("kept") > 0, F.col("kept")).otherwise(plain), "\n")).alias("text"),
    )


def text_usable(docs: DataFrame) -> DataFrame:
    """Is a text worth parsing: long enough, enough distinct lines, at least two with a dosing word?"""
    frame = docs.select(
        "doc_id",
        F.length(tx.strip(F.coalesce("text", F.lit("")))).alias("n_chars"),
        text_lines(F.coalesce("text", F.lit(""))).alias("lines"),
    )
    dosing = F.size(F.filter("lines", lambda s: tx.matches(s, fx.DOSING_WORD)))
    usable = (
        (F.col("n_chars") >= 100)
        & (F.size("lines") >= 4)
        & (F.size(F.array_distinct("lines")) / F.size("lines") >= 0.35)
        & (dosing >= 2)
    )
    return frame.select("doc_id", usable.alias("usable"))


def scrubbed(text: Column) -> Column:
    """Text with personal lines masked, and e-mails, phone numbers and long digit runs replaced."""

    def clean(s: Column) -> Column:
        out = tx.replace(s, fx.EMAIL, "[EMAIL_REDACTED]")
        out = tx.replace(out, fx.PHONE, "[PHONE_REDACTED]", tx.EXACT)
        out = tx.replace(out, fx.LONG_DIGITS, "[ID_REDACTED]", tx.EXACT)
        return F.when(tx.matches(s, fx.PERSONAL_LINE), fx.HIDDEN_LINE).otherwise(out)

    return tx.strip(F.array_join(F.transform(text_lines(text), clean), "\n"))


def scrub_pii(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", scrubbed(F.col("text")))


def scrub_payloads(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Patient fields of a string map redacted, its text fields scrubbed."""
    cleaned = F.transform_values(
        payload,
        lambda k, v: F.when(F.lower(k).isin(fx.PATIENT_KEYS), F.lit("[REDACTED]"))
        .when(F.lower(k).isin("raw_text", "text"), scrubbed(v))
        .otherwise(v),
    )
    return rows.withColumn(payload, cleaned)
