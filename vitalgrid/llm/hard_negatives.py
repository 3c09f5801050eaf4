"""Hard negatives by slots: the positives' upper limits cut the scores into disjoint slots.

Anchors (the stated query set) meet all rows block by block: a tile is one block
of anchors and one block of rows, one matrix product, so work is spread however
many rows a label has. Two rounds of tiles are needed:

1. Tiles within a label keep each anchor's best positives.
2. A positive of score s allows negatives from ceil(s / 2) to floor(0.95 s). The
   upper limits of an anchor's positives, falling, part the scores into slots:
   slot j lies above limit j + 1, up to limit j. Every tile keeps the top k of
   each slot, and so do the combiners before and behind the shuffle (group
   limits). A window is a run of slots that ends at the last one, so merging the
   slots from the last to the first gives the top k below every limit; the lower
   limit then cuts from the end.

Scores are whole numbers and exact: products are taken in doubles while every
sum stays below 2**53, else in integers of any length.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.llm.registry import query
from vitalgrid.session import cut_lineage

ANCHORS = 2_048
ROWS = 8_192
STEP = 256
LEVEL = 64
#: Components beyond this size count as this size; scores beyond a long count as the nearest long.
WIDEST = float(2**53)
LONG = 2**63 - 1


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as whole doubles."""
    return F.transform(
        embedding,
        lambda x: F.greatest(F.least(F.lit(WIDEST), _floor(x.cast("double") * scale)), F.lit(-WIDEST)),
    )


def _floor(x: Column) -> Column:
    """floor as a double (the function of that name gives a long, which ends at 2**63)."""
    down = F.rint(x)
    return F.when(down > x, down - 1).otherwise(down)


def finite(embedding: Column) -> Column:
    """Neither the vector nor a component is null or non-finite."""
    broken = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | F.abs(x.cast("double")).isin(float("inf")))
    return F.coalesce(embedding.isNotNull() & ~broken, F.lit(False))


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number rows, limited to the range of a long."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    if float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1] < 2.0**53:
        return (left @ right.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    product = whole(left).dot(whole(right).T)
    return np.clip(product, -LONG, LONG).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("q").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


BEST = "anchor long, slot int, score long, vec_id long, row long, block int"
_BEST = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("block", pa.int32())])


def _best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group: higher score, smaller id."""
    order = np.lexsort((row, vec_id, -score, group))
    fresh = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    return order[rank < k]


def best_positives(key: tuple, anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """One tile of one label -> each anchor's first k rows with another id."""
    out = []
    mine, ids = anchors.column("row").to_numpy(), anchors.column("vec_id").to_numpy()
    vec_id, row = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
    left, right = _matrix(anchors), _matrix(rows)
    for at in range(0, len(mine), STEP):
        got = scores(left[at : at + STEP], right)
        a, b = np.nonzero(ids[at : at + STEP, None] != vec_id[None, :])
        # A score below an anchor's k-th best of this tile cannot stay.
        if len(vec_id) > k + 1:
            least = np.partition(got, -(k + 1), axis=1)[:, -(k + 1)]
            good = got[a, b] >= least[a]
            a, b = a[good], b[good]
        keep = _best(a, got[a, b], vec_id[b], row[b], k)
        a, b = a[keep], b[keep]
        out.append((mine[at + a], np.zeros(len(a), np.int32), got[a, b], vec_id[b], row[b], np.full(len(a), int(key[-1].as_py()), np.int32)))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_BEST)


def best_in_slots(key: tuple, anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """One tile -> the first k rows of another label in each slot of each anchor."""
    out = []
    mine, labels = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    limits = anchors.column("limits").to_pylist()
    width = max(map(len, limits))
    tops = np.array([x + [-LONG - 1] * (width - len(x)) for x in limits], np.int64)
    floor = anchors.column("floor").to_numpy()
    vec_id, row, other = (rows.column(c).to_numpy() for c in ("vec_id", "row", "label"))
    left, right = _matrix(anchors), _matrix(rows)
    for at in range(0, len(mine), STEP):
        some = slice(at, at + STEP)
        got = scores(left[some], right)
        a, b = np.nonzero((got <= tops[some, :1]) & (got >= floor[some, None]) & (labels[some, None] != other[None, :]))
        score = got[a, b]
        slot = (tops[some][a] >= score[:, None]).sum(axis=1) - 1
        keep = _best(a * width + slot, score, vec_id[b], row[b], k)
        a, b = a[keep], b[keep]
        out.append((mine[at + a], slot[keep].astype(np.int32), score[keep], vec_id[b], row[b], np.full(len(a), int(key[-1].as_py()), np.int32)))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_BEST)


def _tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], fn) -> DataFrame:
    """Every block of anchors with every block of rows that has the same keys."""
    sizes = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("anchor_blocks")).join(
        rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("row_blocks")), keys
    )
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = (
        anchors.join(sizes, keys).withColumn("i", block("anchor_blocks"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    )
    right = (
        rows.join(sizes, keys).withColumn("j", block("row_blocks"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)))
    )
    tile = [*keys, "i", "j"]
    left = left.toDF(*left.columns)  # both sides may stem from one table
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(fn, BEST)


def _top(found: DataFrame, k: int, blocks: int) -> DataFrame:
    """First k of each (anchor, slot), merged ``LEVEL`` blocks at a time; group limits combine before each shuffle."""
    order = [F.desc("score"), "vec_id", "row"]
    while True:
        by = Window.partitionBy("anchor", "slot", "block").orderBy(*order)
        blocks = -(-blocks // LEVEL)
        found = found.withColumn("block", F.floor(F.col("block") / LEVEL).cast("int")) if blocks > 1 else found.withColumn("block", F.lit(0))
        found = found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
        if blocks <= 1:
            return found.drop("block")
        found = found.drop("place")


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3,
    low: Fraction = Fraction(1, 2), high: Fraction = Fraction(95, 100), scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label. Anchors are the rows whose
    vec_id is divisible by ``every``; an anchor's positives are its first
    ``positives`` rows of its label with another vec_id, and each positive takes
    the first ``negatives`` rows of another label whose score lies between
    ``low`` and ``high`` times its own (both ends included; a positive below zero
    has none). Higher scores come first, then smaller ids.

    Rows with a null vec_id, label, vector or component, or a non-finite
    component, take no part. Vectors of different lengths never meet. A row that
    repeats another in id, label and vector counts once; rows that share only an
    id are rows of their own. Components beyond 2**53 after scaling count as
    that, scores beyond a long as the nearest long. Extra columns are not read;
    an empty table, or one label only, gives no rows.
    """
    q = quantised(F.col("embedding"), scale)
    kept = cut_lineage(
        vectors.filter(finite(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
        .select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q"))
        .withColumn("row", F.xxhash64("vec_id", "label", "q")).withColumn("dims", F.size("q"))
        .dropDuplicates(["vec_id", "label", "dims", "row"])
    )
    anchors = kept.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-kept.count() // ROWS))

    def positives_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return best_positives(key, left, right, positives) if left.num_rows and right.num_rows else _BEST.empty_table()

    def slots_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return best_in_slots(key, left, right, negatives) if left.num_rows and right.num_rows else _BEST.empty_table()

    lo = lambda s: F.expr(f"cast(ceil(cast({s} as decimal(20,0)) * {low.numerator} / {low.denominator}) as bigint)")
    hi = lambda s: F.expr(f"cast(floor(cast({s} as decimal(20,0)) * {high.numerator} / {high.denominator}) as bigint)")
    own = (
        _top(_tiles(anchors, kept, ["label", "dims"], positives_of), positives, blocks)
        .filter("score >= 0").withColumn("low", lo("score")).withColumn("high", hi("score"))
    )
    windows = cut_lineage(
        own.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high", "score", "vec_id"))).alias("windows"))
    )
    asking = (
        anchors.join(windows, anchors["row"] == windows["anchor"])
        .select(
            "vec_id", "label", "dims", "row", "q",
            F.transform("windows", lambda w: w["high"]).alias("limits"), F.element_at("windows", -1)["low"].alias("floor"),
        )
    )
    found = _top(_tiles(asking, kept, ["dims"], slots_of), negatives, blocks)
    slots = found.groupBy("anchor", "slot").agg(
        F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("best")
    ).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    # From the last slot to the first: what is below limit j is slot j, then what is below limit j + 1.
    empty = F.expr("cast(array() as array<array<struct<place: int, score: bigint, vec_id: bigint>>>)")
    none = F.expr("cast(array() as array<struct<place: int, score: bigint, vec_id: bigint>>)")
    numbers = F.reverse(F.sequence(F.lit(0), F.size("windows") - 1))
    suffixes = F.aggregate(
        numbers, empty,
        lambda done, j: F.concat(
            F.array(F.slice(F.concat(
                F.coalesce(F.try_element_at("slots", j.cast("int")), none),
                F.when(F.size(done) > 0, F.try_element_at(done, F.lit(1))).otherwise(none),
            ), 1, negatives)),
            done,
        ),
    )
    answered = windows.join(slots, "anchor").select("anchor", F.explode(F.arrays_zip("windows", suffixes.alias("found"))).alias("w"))
    within = F.filter(F.col("w.found"), lambda x: x["score"] >= F.col("w.windows.low"))
    ranked = answered.select("anchor", "w.windows.vec_id", "w.windows.score", F.posexplode(within).alias("at", "negative"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(names, "anchor").select(
        "anchor_id", F.col("vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), F.col("score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", ORACLE)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors divisible by 50 against all vectors, labels shifted where the id is divisible by 7."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label))
