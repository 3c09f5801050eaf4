"""Mixing sources to target weights: subset-sum budget fitting over exact document lengths.

A source whose target is q times its size and a rest repeats every document q
times; the rest is a budget of words to fill with whole documents. They are not
looked at one by one: documents are counted by exact length, every length gives
the same share of its documents (rounded down), the gap this leaves is narrowed
with one more document of falling lengths, and a bounded-knapsack table over the
last ``TABLE`` words, or the longest length, closes it. Which documents of a
length are taken is decided by a seeded hash, through a threshold found from
counts of hash ranges, so no length is ranked as a whole in one task.

The fit of a source works on its lengths and their counts, which are bounded by
the longest document, not by the number of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of
from vitalgrid.llm.registry import query
from vitalgrid.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 12
TABLE = 65_536
PER_RANGE = 8_192


def n_words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """How many of each length (up to its count) come nearest to ``budget``, and the words left (negative: too many).

    Counts are split into powers of two; ``came_by`` keeps the part by which a
    sum was first reached, which is enough to walk back.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken, budget
    usable = np.flatnonzero((lengths > 0) & (counts > 0))
    # A sum above the budget can be nearer than one below; beyond twice the budget none is nearer than nothing.
    most = min(2 * budget, budget + (int(lengths[usable].max()) if len(usable) else 0))
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    came_by = np.full(most + 1, -1, np.int64)
    parts: list[tuple[int, int]] = []
    for i in usable.tolist():
        left, some = min(int(counts[i]), most // int(lengths[i])), 1
        while left and not reached[budget]:
            some = min(some, left)
            weight = some * int(lengths[i])
            if weight > most:
                break
            fresh = np.flatnonzero(reached[: most + 1 - weight] & ~reached[weight:]) + weight
            came_by[fresh] = len(parts)
            reached[fresh] = True
            parts.append((i, some))
            left -= some
            some *= 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - budget).argmin()])
    rest = budget - at
    while at:
        i, some = parts[came_by[at]]
        taken[i] += some
        at -= some * int(lengths[i])
    return taken, rest


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``."""
    sizes, have = lengths.astype(np.int64), counts.astype(np.int64)
    total = int(sum(a * b for a, b in zip(sizes.tolist(), have.tolist(), strict=True)))
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return np.where(sizes > 0, have, 0)
    share = np.array([c * budget // total if s else 0 for s, c in zip(sizes.tolist(), have.tolist(), strict=True)], np.int64)
    gap = budget - int((share * sizes).sum())
    narrow = max(table, int(sizes.max()))
    for i in np.argsort(-sizes, kind="stable").tolist():
        if gap <= narrow or not sizes[i]:
            break
        if share[i] < have[i] and sizes[i] <= gap:
            share[i] += 1
            gap -= int(sizes[i])
    order = np.random.default_rng(seed).permutation(len(sizes))
    more, _ = knapsack(sizes[order], (have - share)[order], gap)
    share[order] += more
    return share


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also target: shares of all words by weight, no source above ``cap`` times its size.

    What sources at their cap leave is shared again by weight until none is
    above; each round is one aggregate over the sources. Weights repeat along
    the sources by code point, null last.
    """
    placed = cut_lineage(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    )
    # The place in the order: sources in earlier partitions, and the place within the own one.
    before = placed.groupBy(F.shiftrightunsigned("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    place = F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighted = cut_lineage(
        placed.withColumn("part", F.shiftrightunsigned("at", 33)).join(before, "part")
        .withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
        .select("source", "source_size", "weight", (F.col("source_size") * cap).alias("most"))
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    rest, level = None, None
    while True:
        # Sources at their cap at the last level, and what the others share at the new one.
        full = F.lit(False) if level is None else F.col("most") * F.lit(level[1]) < F.col("weight") * F.lit(level[0])
        got = weighted.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0)).alias("given"), F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("open")
        ).first()
        now = (total - (got.given or 0), got.open or 0)
        if now == (rest or ()) or now[1] == 0:
            break
        rest, level = now, tuple(_decimal(x) for x in now)
    if rest is None:
        return weighted.select("source", "source_size", F.lit(0.0).alias("target"))
    share = (F.col("weight") * F.lit(rest[0])).cast("double") / F.lit(float(rest[1]))
    above = F.col("most") * F.lit(level[1]) < F.col("weight") * F.lit(level[0])
    return weighted.select("source", "source_size", F.when(above, F.col("most").cast("double")).otherwise(share).alias("target"))


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


FITTED = "source string, size long, epochs long, extra long, n long"


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, carry: list[str] = (),
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken and the ``carry`` columns.

    ``size`` counts the words of the whole text, ``target`` is what its source
    should give to the mix, ``taken`` the words of this row in the mix: its size
    times the number of copies, at most ``cap`` times its size. The taken words
    of a source are the subset sum nearest to its target, rounded, among those
    looked at; they meet it where short documents allow.

    Null and empty texts have size 0 and give nothing. A null source is one of
    its own, last in the order. Which documents of a length repeat once more is
    decided by a hash of seed, doc_id and text. Rows alike in all three are
    told apart only by their number, so a rerun gives the same rows. Extra
    columns are not read unless carried; an empty table gives no rows.
    """
    carry = list(carry)
    key = F.struct(F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.col("doc_id").cast("string").alias("d"))
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("key"),
        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    rows = cut_lineage(sized)
    counts = cut_lineage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cut_lineage(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap))

    def fitted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", kind="stable")
        lengths, have = part["size"].to_numpy(), part["n"].to_numpy()
        total, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        budget = min(round(target), cap * total)
        epochs = budget // total if total else 0
        extra = fit_lengths(lengths, have, budget - epochs * total, seed)
        return pd.DataFrame({"source": part["source"], "size": lengths, "epochs": epochs, "extra": extra, "n": have})

    same = counts["source"].eqNullSafe(sources["source"])
    plan = cut_lineage(
        counts.join(sources, same).select(counts["source"], "size", "n", "source_size", "target")
        .groupBy("source").applyInPandas(fitted, FITTED)
    )
    cuts = _thresholds(rows, plan)
    keyed = plan.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.join(
        cuts.toDF("s", "z", "cut", "whole", "k"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left"
    ).drop("s", "z").toDF("s", "z", *[c for c in keyed.columns if c not in ("source", "size")], "cut", "whole", "k")
    decided = rows.join(keyed, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    once_more = (
        F.when(F.col("extra") == 0, False).when(F.col("extra") == F.col("n"), True)
        .when(F.col("key") == F.col("cut"), F.col("whole")).otherwise(F.col("key") < F.col("cut"))
    )

    def taken(frame: DataFrame, more: Column) -> DataFrame:
        return frame.select(
            "doc_id", "size", "source_size", "target",
            (F.col("size") * (F.col("epochs") + more.cast("long"))).alias("taken"),
            *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
        )

    # Rows alike in doc_id and text at a cut, of which only some repeat, are dealt by number.
    split = F.coalesce((F.col("key") == F.col("cut")) & ~F.col("whole"), F.lit(False))
    alike = decided.filter(split).withColumn("part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    number = _numbered(cut_lineage(alike))
    return taken(decided.filter(~split), once_more).unionByName(taken(number, F.col("number") < F.col("k")))


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, cut, whole, k) of the lengths of which only some documents repeat once more.

    Keys below ``cut`` are taken; of the rows at it, all (``whole``) or ``k``.
    """
    some = plan.filter("extra > 0 AND extra < n").toDF("s", "z", "epochs", "extra", "n")
    place = F.expr("(cast(key.h as double) + 9223372036854775808D) / 18446744073709551616D")
    ranges = F.ceil(F.col("n") / PER_RANGE)
    ranged = (
        rows.select("source", "size", "key").join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .select("source", "size", "key", "extra", F.least(F.floor(place * ranges), ranges - 1).alias("range"))
    )
    per_range = ranged.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("n"), F.first("extra").alias("extra"))
    along = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    border = (
        per_range.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .filter("before < extra AND before + n >= extra").select("source", "size", "range", (F.col("extra") - F.col("before")).alias("need"))
        .toDF("s", "z", "r", "need")
    )
    within = ranged.join(
        border, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("range") == F.col("r"))
    )
    keys = within.groupBy("source", "size", "key").agg(F.count(F.lit(1)).alias("m"), F.first("need").alias("need"))
    along = Window.partitionBy("source", "size").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keys.withColumn("before", F.coalesce(F.sum("m").over(along), F.lit(0)))
        .filter("before < need AND before + m >= need")
        .select(
            "source", "size", F.col("key").alias("cut"), (F.col("before") + F.col("m") == F.col("need")).alias("whole"),
            (F.col("need") - F.col("before")).alias("k"),
        )
    )


def _numbered(alike: DataFrame) -> DataFrame:
    """Numbers from 0 along the rows of one (source, size): counts of earlier partitions, then the place in the own one."""
    counted = alike.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("source", "size", "part", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("before")).toDF("s2", "z2", "p2", "before")
    joined = alike.join(
        before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("part") == F.col("p2"))
    )
    within = Window.partitionBy("source", "size", "part").orderBy("key")
    return joined.withColumn("number", F.col("before") + F.row_number().over(within) - 1)


@query("op12_source_mix")
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words the mix takes of them."""
    return mix_sources(documents_of(spark, folder))
