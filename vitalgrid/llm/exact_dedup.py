"""Exact duplicates by a tree merge of sorted digest runs. DataFrame functions only.

Every document gets a leaf run from a hash of its id. In each round of a binomial
tree (``fan_in`` 2; a wider one merges more runs at once) the second run of every
pair joins the first, which keeps its number, so half of the runs stay where they
are. The survivor is a struct, which the engine aggregates by sorting: each round
merges runs sorted by digest, and rows with equal digests leave one row with the
surviving id and the group's size. After the last round one run is left. The
survivor then travels back down the same tree, so that no join ever brings all
copies of one text to one task: a text that a third of all documents share is
cut into as many pieces as there are leaf runs, and each inner node has at most
``fan_in`` children.

Two rows are merged only where SHA-256, byte length and a second, independent
64-bit hash of the text all agree, which every round compares anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import ascii_lower, documents_of, shuffle_partitions
from vitalgrid.llm.registry import query
from vitalgrid.session import cut_lineage

SAME = ["digest", "n_bytes", "check"]


def tree_levels(runs: int, fan_in: int) -> int:
    """Rounds until ``runs`` runs are one."""
    return max(1, math.ceil(math.log(max(runs, 2)) / math.log(fan_in) - 1e-9))


def exact_duplicates(docs: DataFrame, keep: str = "max", fan_in: int = 2, runs: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the id
    that stays, ``"max"`` or ``"min"``. A null text counts as empty. Rows that
    repeat an id are rows of their own in ``group_size``; all rows carrying the
    surviving id are kept. A row without id survives only in a group without
    any id (``keep_id`` null). Columns besides doc_id and text are not read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    levels = tree_levels(runs or shuffle_partitions(spark), fan_in)
    leaf_runs = fan_in**levels
    # ids before nulls either way; a struct keeps the merge a sorted one
    best, first = {"max": (F.max, F.isnotnull), "min": (F.min, F.isnull)}[keep]
    ranked = F.struct(first(F.col("doc_id")), F.col("doc_id").alias("id"))
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = cut_lineage(
        docs.select("doc_id", text.alias("norm")).select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id", F.lit("leaf")), F.lit(leaf_runs)).cast("int").alias("run"),
            F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"),
        )
    )
    sizes = F.count(F.lit(1)).alias("size")
    up = [rows.withColumn("best", ranked).groupBy(*SAME, "run").agg(best("best").alias("best"), sizes)]
    receivers = [(F.col("run") - F.col("run") % F.lit(fan_in ** (level + 1))).cast("int") for level in range(levels)]
    for receiver in receivers:
        up.append(
            up[-1]
            .withColumn("run", receiver)
            .groupBy(*SAME, "run")
            .agg(best("best").alias("best"), F.sum("size").alias("size"))
        )
    settled = up[-1].select(*SAME, "run", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))
    for level, receiver in zip(reversed(up[:-1]), reversed(receivers), strict=True):
        child = level.select(*SAME, F.col("run").alias("sender"), receiver.alias("run"))
        settled = child.join(settled, [*SAME, "run"]).select(
            *SAME, F.col("sender").alias("run"), "keep_id", "group_size"
        )
    return rows.join(settled, [*SAME, "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


@query("op8_exact_dedup", ORACLE)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_duplicates(documents_of(spark, folder))
