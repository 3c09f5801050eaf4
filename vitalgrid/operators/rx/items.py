"""Blocks to medication items: fields, names, five strategies and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions import rx_fixed as fx
from vitalgrid.functions import rx_text as tx
from vitalgrid.functions.plan import computed_once
from vitalgrid.operators.rx import lines as ln

ITEM = ["name", "dosage", "strength", "instructions", "times_per_day", "specific_times", "confidence"]


def extract_fields(blocks: DataFrame) -> DataFrame:
    """Dosage, strength, times and instruction text out of a ``block`` column."""
    block, low = F.col("block"), F.col("__low")
    return (
        blocks.withColumn("__low", tx.folded(block))
        .withColumn("dosage", tx.dosage(block, low))
        .withColumn("strength", tx.strength(block))
        .withColumn("__said", tx.named_clocks(block, low))
        .withColumn("times_per_day", tx.times_per_day(low, F.col("__said")))
        .withColumn("specific_times", tx.clocks_or_default(F.col("__said"), F.col("times_per_day")))
        .withColumn("instructions", tx.instructions(low, F.col("specific_times"), F.col("times_per_day")))
        .drop("__said", "__low")
    )


def clean_names(rows: DataFrame, raw: str = "raw", block: str = "block") -> DataFrame:
    """Add ``name``: the cleaned and canonical name of ``raw`` in its block."""
    named = tx.with_clean_name(rows, "__name", F.col(raw))
    return computed_once(named.withColumn("name", tx.canonical_name(F.col("__name"), F.col(block))).drop("__name"))


def item_confidence(items: DataFrame) -> DataFrame:
    return items.withColumn("confidence", tx.confidence(F.col("name"), F.col("specific_times"), F.col("dosage")))


def build_items(rows: DataFrame, fixed_confidence: float | None = None) -> DataFrame:
    """Rows with name and block become items; names below 3 characters give none."""
    built = extract_fields(rows.filter(F.length("name") >= 3))
    return item_confidence(built) if fixed_confidence is None else built.withColumn("confidence", F.lit(fixed_confidence))


def plausible_items(items: DataFrame) -> DataFrame:
    return items.filter(tx.plausible(F.col("name")))


def best_items(items: DataFrame) -> DataFrame:
    """Plausible items, one per identity: highest confidence, longest name, first; placed where the identity first stood."""
    rank = F.struct(-F.col("confidence"), -F.length("name"), F.col("pos"))
    payload = F.struct(*[c for c in items.columns if c not in ("doc_id", "pos")])
    return (
        plausible_items(computed_once(items))
        .withColumn("identity", tx.identity_key(F.col("name")))
        .groupBy("doc_id", "identity")
        .agg(F.min_by(payload, rank).alias("best"), F.min("pos").alias("pos"))
        .select("doc_id", "pos", "best.*")
    )


def _item_columns(items: DataFrame) -> DataFrame:
    return items.select("doc_id", "pos", *ITEM)


def parse_block_items(blocks: DataFrame) -> DataFrame:
    """One item per block that looks like a medicine."""
    flat = tx.one_line(F.col("block"))
    unnumbered = tx.replace(flat, r"^\s*[\W_]{0,4}\s*\d{1,2}\s*(?:[.)/\-]\s*|\s+)", "", tx.EXACT)
    rows = (
        computed_once(blocks.withColumn("block", unnumbered))
        .filter(F.col("block") != "")
        .filter(tx.medicine_block(F.col("block")))
    )
    return _item_columns(build_items(clean_names(rows, "block")))


def _group_rows(groups: DataFrame) -> DataFrame:
    """One row per group: joined text, marker, and the name found on its first or best later line."""
    tail = r"\s+\d{1,3}\s*(?:vi[eê]n|g[oó]i|[oô]ng)\b.*$"
    start = F.when(F.col("opens"), tx.strip_marker(F.col("line"))).otherwise(F.col("line"))
    named = tx.with_clean_name(groups, "cand", tx.replace(start, tail, ""))
    dosed = tx.matches(F.lower("cand"), rf"\d+(?:[.,]\d+)?\s*(?:{fx.STRENGTH_UNIT})\b", tx.EXACT)
    score = dosed.cast("int") + tx.possible_medication(F.col("cand")).cast("int")
    usable = ~F.col("opens") & (F.length("cand") >= 4)
    return (
        named.withColumn("score", F.when(usable, score))
        .groupBy("doc_id", "group_no")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n"
            ).alias("block"),
            F.max("marker").alias("marker"),
            F.max(F.when(F.col("opens"), F.col("cand"))).alias("head"),
            F.max_by("cand", F.when(usable, F.struct("score", F.length("cand"), -F.col("line_no")))).alias("later"),
        )
        .withColumn("raw", F.when(F.length("head") >= 4, F.col("head")).otherwise(F.coalesce("later", F.lit(""))))
    )


def parse_numbered_items(groups: DataFrame) -> DataFrame:
    """One item per marker number, read from the marker line and the lines below it."""
    rows = (
        _group_rows(groups)
        .filter((F.col("raw") != "") & (tx.medicine_block(F.col("block")) | (F.length("raw") >= 4)))
        .withColumn("name", tx.canonical_name(F.col("raw"), F.col("block")))
    )
    built = build_items(rows)
    rank = F.struct(-F.col("confidence"), -F.length("name"), F.col("group_no"))
    per_marker = (
        built.groupBy("doc_id", "marker")
        .agg(F.min_by(F.struct(*ITEM), rank).alias("best"))
        .select("doc_id", F.col("marker").alias("pos"), "best.*")
    )
    return _item_columns(best_items(per_marker))


def parse_head_items(lines: DataFrame) -> DataFrame:
    """Items from marker lines alone: the first usable line of each number."""
    line = F.col("line")
    marked = (
        lines.filter(tx.matches(line, fx.LINE_MARKER, tx.EXACT))
        .withColumn("pos", tx.first(line, fx.LINE_MARKER, 1, tx.EXACT).cast("int"))
    )
    rows = (
        tx.with_clean_name(marked, "raw", tx.strip_marker(line))
        .withColumn("__low", F.lower("raw"))
        .filter(F.length("raw") >= 3)
        .filter((F.length(F.regexp_replace("__low", "[^a-zà-ỹ]+", "")) >= 5) | tx.has_signal(F.col("__low")))
        .withColumn("block", line)
        .withColumn("name", tx.canonical_name(F.col("raw"), line))
        .filter(F.length("name") >= 3)
        .groupBy("doc_id", "pos")
        .agg(F.min_by(F.struct("name", "block"), "line_no").alias("r"))
        .select("doc_id", "pos", "r.*")
    )
    return _item_columns(best_items(build_items(rows)))


def parse_relaxed_items(lines: DataFrame) -> DataFrame:
    """Every line that may be a medication, for badly broken text."""
    line = F.col("line")
    flat = tx.replace(tx.one_line(line), r"^\s*[\W_]{0,4}\s*\d{1,2}\s*(?:[.)/\-]\s*|\s+)", "", tx.EXACT)
    rows = (
        lines.filter(tx.possible_medication(line))
        .select("doc_id", "line_no", "line", flat.alias("__flat"))
        .withColumn("__plain", (F.col("__flat") != "") & tx.medicine_block(F.col("__flat")))
    )
    # a name is read off the line as it stands only where the block gives none
    rows = tx.with_clean_name(rows, "__strict", F.when(F.col("__plain"), F.col("__flat")))
    rows = rows.withColumn("__strict", tx.canonical_name(F.col("__strict"), F.col("__flat")))
    rows = rows.withColumn("strict", F.col("__plain") & (F.coalesce(F.length("__strict"), F.lit(0)) >= 3))
    strict = F.col("strict")
    picked = (
        tx.with_clean_name(rows, "__loose", F.when(~strict, line))
        .filter(strict | (F.length("__loose") >= 4))
        .withColumn("block", F.when(strict, F.col("__flat")).otherwise(line))
        .withColumn("name", F.when(strict, F.col("__strict")).otherwise(tx.canonical_name(F.col("__loose"), line)))
    )
    said = tx._point(tx.first(line, fx.DOSAGE))
    built = (
        build_items(picked)
        .withColumn("confidence", F.when(F.col("strict"), F.col("confidence")).otherwise(F.lit(0.46)))
        .withColumn(
            "dosage",
            F.when(F.col("strict"), F.col("dosage")).when(said == "", F.lit(fx.NO_DOSE)).otherwise(said),
        )
        .withColumn("pos", F.col("line_no"))
    )
    return _item_columns(best_items(_item_columns(built)))


def parse_tabular_items(lines: DataFrame) -> DataFrame:
    """Quantity lines of tables: the name stands left of the quantity word, or on the line before or after."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    header = lambda c: tx.matches(c, fx.TABLE_HEADER)
    left = tx.strip(tx.replace(F.col("line"), fx.QUANTITY_WORD + ".*$", ""))
    options = F.array(
        F.struct(F.lit(0).alias("o"), left.alias("text")),
        F.struct(F.lit(1).alias("o"), F.coalesce(F.lag("line").over(w), F.lit("")).alias("text")),
        F.struct(F.lit(2).alias("o"), F.coalesce(F.lead("line").over(w), F.lit("")).alias("text")),
    )
    rows = (
        lines.withColumn("options", options)
        .filter(~header(F.col("line")) & tx.matches(F.col("line"), fx.QUANTITY_WORD))
        .select("doc_id", "line_no", "line", F.explode("options").alias("opt"))
        .filter(F.length("opt.text") >= 5)
    )
    rows = (
        tx.with_clean_name(rows, "raw", F.col("opt.text"))
        .filter((F.length("raw") >= 4) & ~header(F.col("raw")))
        .withColumn("name", tx.canonical_name(F.col("raw"), F.col("opt.text")))
        .withColumn("block", F.concat_ws(" ", "opt.text", "line"))
        .groupBy("doc_id", F.col("line_no").alias("pos"))
        .agg(F.min_by(F.struct("name", "block"), "opt.o").alias("r"))
        .select("doc_id", "pos", "r.*")
    )
    return _item_columns(best_items(build_items(rows, 0.42)))


def choose_strategy(counts: DataFrame) -> DataFrame:
    """Strategy per document from item counts (block, numbered, head, relaxed), reliable and n_chars."""
    n = {c: F.coalesce(c, F.lit(0)) for c in ("block", "numbered", "head", "relaxed")}
    reliable = F.coalesce("reliable", F.lit(False))
    base = (
        F.when(reliable & (n["head"] >= 2), F.when(n["numbered"] > n["head"], "numbered").otherwise("numbered_head"))
        .when(reliable & (n["numbered"] >= 2), "numbered")
        .when(n["block"] > 0, "block")
        .otherwise("none")
    )
    size = (
        F.when(F.col("base") == "numbered", n["numbered"])
        .when(F.col("base") == "numbered_head", n["head"])
        .when(F.col("base") == "block", n["block"])
        .otherwise(F.lit(0))
    )
    relaxed = ((F.col("size") == 0) & (F.col("n_chars") >= 120) & (n["relaxed"] > 0)) | (
        (F.col("size") > 0) & (F.col("size") <= 2) & (F.col("n_chars") >= 650) & (n["relaxed"] > F.col("size"))
    )
    return (
        counts.withColumn("base", base)
        .withColumn("size", size)
        .select("doc_id", F.when(relaxed, "relaxed").otherwise(F.col("base")).alias("strategy"))
    )


def strategy_counts(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts per document and strategy next to marker reliability and text length."""
    per_doc = candidates.groupBy("doc_id").agg(
        *[
            F.count_if(F.col("strategy") == s).alias(c)
            for s, c in (("block", "block"), ("numbered", "numbered"), ("numbered_head", "head"), ("relaxed", "relaxed"))
        ]
    )
    sizes = lines.groupBy("doc_id").agg((F.sum(F.length("line") + 1) - 1).alias("n_chars"))
    return sizes.join(per_doc, "doc_id", "left").join(ln.marker_sequence(ln.line_groups(lines)), "doc_id", "left")


def candidate_items(lines: DataFrame) -> DataFrame:
    """Items of all strategies, tagged."""
    tag = lambda items, name: items.withColumn("strategy", F.lit(name))
    return (
        tag(parse_block_items(ln.split_blocks(lines)), "block")
        .unionByName(tag(parse_numbered_items(ln.line_groups(lines)), "numbered"))
        .unionByName(tag(parse_head_items(lines), "numbered_head"))
        .unionByName(tag(parse_relaxed_items(lines), "relaxed"))
    )


def drop_duplicate_pairs(items: DataFrame) -> DataFrame:
    """First item per (name, dosage), regardless of case."""
    norm = lambda c: tx.strip(F.lower(F.coalesce(c, F.lit(""))))
    payload = F.struct(*[c for c in items.columns if c != "doc_id"])
    return (
        items.groupBy("doc_id", norm("name").alias("__n"), norm("dosage").alias("__d"))
        .agg(F.min_by(payload, "pos").alias("r"))
        .select("doc_id", "r.*")
    )


def parse_json_docs(docs: DataFrame) -> DataFrame:
    """Items of documents that are structured model output, possibly inside a code fence.

    The list is the document itself or the first list under a known wrapper key;
    names, doses and instructions come under several keys; entries that are no
    objects, or have no name, are skipped.
    """
    parsed = docs.select("doc_id", F.try_parse_json(strip_fence(F.col("text"))).alias("v"))
    is_list = lambda c: F.coalesce(F.schema_of_variant(c).startswith("ARRAY"), F.lit(False))
    wrapped = [F.try_variant_get("v", f"$.{k}", "variant") for k in fx.LIST_KEYS]
    chosen = F.when(is_list(F.col("v")), F.col("v"))
    for w in wrapped:
        chosen = chosen.when(is_list(w), w)
    entries = F.try_variant_get(chosen, "$", "array<variant>")
    rows = parsed.select("doc_id", F.posexplode(entries).alias("pos", "e")).filter(
        F.schema_of_variant("e").startswith("OBJECT")
    )

    def text_of(keys: list[str]) -> Column:
        """First value that is neither absent, null, empty, zero, false nor an empty container."""
        found = []
        for k in keys:
            val = F.try_variant_get("e", f"$.{k}", "string")
            kind = F.schema_of_variant(F.try_variant_get("e", f"$.{k}", "variant"))
            empty = F.when(kind == "STRING", val == "").otherwise(val.isin("0", "false", "[]", "{}"))
            found.append(F.when(val.isNotNull() & ~empty, tx.strip(val)))
        return F.coalesce(*found, F.lit(""))

    freq = F.coalesce(*[F.try_variant_get("e", f"$.{k}", "int") for k in fx.FREQUENCY_KEYS], F.lit(1))
    dose = text_of(fx.DOSE_KEYS)
    return (
        rows.withColumn("name", text_of(fx.NAME_KEYS))
        .filter(F.col("name") != "")
        .select(
            "doc_id",
            "pos",
            "name",
            F.when(dose == "", fx.JSON_DOSE).otherwise(dose).alias("dosage"),
            F.lit("").alias("strength"),
            text_of(fx.INSTRUCTION_KEYS).alias("instructions"),
            freq.alias("times_per_day"),
            F.coalesce(
                F.try_variant_get("e", "$.specific_times", "array<string>"), F.array().cast("array<string>")
            ).alias("specific_times"),
            F.coalesce(F.try_variant_get("e", "$.confidence", "double"), F.lit(fx.JSON_CONFIDENCE)).alias("confidence"),
        )
    )


FENCE = r"^```(?:json|JSON)?\s*\n(.*?)\n?```\s*$"


def strip_fence(text: Column) -> Column:
    """Content of a code fence, or the trimmed text."""
    body = tx.strip(F.coalesce(text, F.lit("")))
    inner = tx.strip(tx.first(body, FENCE, 1, "(?Us)"))
    return F.when(body.rlike("(?Us)" + FENCE), inner).otherwise(body)
