"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Exact copies are folded first, so a vector that a third of all rows repeat is one
vector with a weight. Centroids are fitted on a bounded sample; every vector has
a home cell (the centroid of largest cosine) and visits the cells whose cosine is
within ``MARGIN`` of that. Vectors of one home are compared with each other and
with the visitors, block by block as matrix products in double precision, so a
crowded cell becomes more tasks and not a larger one. A pair that meets in two
cells counts in one of them.

A pair is missed only if each one's home is out of the other's margin. The
products are exact: no pair below the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.graph import components
from vitalgrid.llm.registry import query
from vitalgrid.session import cut_lineage

THRESHOLD = 0.95
MARGIN = 0.12
SAMPLE = 60_000
PER_CELL = 1_000
MAX_CELLS = 4_096
ROUNDS = 6
BLOCK = 1_024
SMALL, LARGE = 1e-100, 1e100


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; fewer if there are fewer vectors."""
    k = min(k, len(vectors))
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 0):
        home = np.concatenate([(vectors[a : a + 8192] @ centroids.T).argmax(axis=1) for a in range(0, len(vectors), 8192)])
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(vectors[order], first, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        good = length[:, 0] > 0
        centroids[cells[good]] = sums[good] / length[good]
    return centroids


def unit_rows(column: pa.Array) -> np.ndarray:
    """(n, d) unit vectors of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


VISITS = "vec long, weight long, home int, visits array<int>, embedding array<double>"


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, margin: float) -> Iterator[pa.RecordBatch]:
    """(vec, weight, embedding) -> home cell and the cells visited."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            some = batch.slice(at, 2048)
            near = unit_rows(some.column(2)) @ centroids.T
            home = near.argmax(axis=1)
            best = near[np.arange(len(home)), home]
            close = near >= best[:, None] - margin
            close[np.arange(len(home)), home] = False
            row, cell = np.nonzero(close)
            ends = np.concatenate([[0], np.cumsum(close.sum(axis=1))]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(home.astype(np.int32)), visits, some.column(2)],
                names=["vec", "weight", "home", "visits", "embedding"],
            )


FOUND = "a long, b long, n long"


def compare(key: tuple, rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between block i (at home) and block j (at home or visiting) of a cell.

    Returns link counts as (vec, null, n) and a spanning forest as (a, b, 0).
    """
    cell, i, j, guests = key
    rows = rows.sort_values("vec", kind="stable").reset_index(drop=True)
    unit = np.array(rows["embedding"].tolist(), dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    vec, weight, home = rows["vec"].to_numpy(), rows["weight"].to_numpy(), rows["home"].to_numpy()
    left, right = np.flatnonzero(rows["side"].to_numpy() == 0), np.flatnonzero(rows["side"].to_numpy() == 1)
    if not guests and i == j:
        right = left
    x, y = np.nonzero(unit[left] @ unit[right].T >= threshold)
    x, y = left[x], right[y]
    if guests:
        # The pair also meets at the guest's home if this side visits there; the smaller cell counts it.
        sizes = rows["visits"].str.len().to_numpy()
        visits = (np.repeat(np.arange(len(rows)), sizes) << 32) + np.concatenate([np.zeros(0, np.int64), *rows["visits"]]).astype(np.int64)
        twice = np.isin((x.astype(np.int64) << 32) + home[y], visits)
        keep = ~twice | (cell < home[y])
        x, y = x[keep], y[keep]
    elif i == j:
        keep = x < y
        x, y = x[keep], y[keep]
    counts = np.bincount(x, weights=weight[y], minlength=len(vec)) + np.bincount(y, weights=weight[x], minlength=len(vec))
    group = np.arange(len(vec))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    heads = np.flatnonzero(np.diff(x, prepend=-1))
    for a, b in zip(heads, [*heads[1:], len(x)] if len(heads) else [], strict=True):
        found = np.unique(np.append(group[y[a:b]], group[x[a]]))
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]
    linked, counted = np.flatnonzero(group != np.arange(len(vec))), np.flatnonzero(counts)
    return pd.DataFrame(
        {
            "a": np.concatenate([vec[counted], vec[linked]]),
            "b": pd.array([*[None] * len(counted), *vec[group[linked]]], dtype="Int64"),
            "n": np.concatenate([counts[counted], np.zeros(len(linked))]).astype(np.int64),
        }
    )


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, sample: int = SAMPLE, per_cell: int = PER_CELL
) -> DataFrame:
    """Per input row: vec_id, n_links, component_id, kept.

    ``n_links`` counts other rows linked directly (copies included),
    ``component_id`` is the smallest vec_id reachable, ``kept`` marks it. Vectors
    that are null, empty, zero or hold a null or non-finite number link with
    nothing; vectors of different lengths never link. Rows with one vec_id are
    rows of their own in the counts but share their component. Other columns are
    not read; an empty table gives no rows. The sample for the centroids has
    ``sample`` vectors at most, those with the smallest hashes of their contents.
    """
    spark = vectors.sparkSession
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.abs(x.cast("double")).isin(float("inf")))
    largest = F.array_max(F.transform("embedding", F.abs))
    valid = F.col("embedding").isNotNull() & ~F.coalesce(broken, F.lit(True)) & (F.coalesce(largest, F.lit(0.0)) > 0)
    # A cosine does not depend on lengths: vectors whose squares would leave the doubles are divided by their largest number.
    plain = largest.between(SMALL, LARGE)
    sized = F.when(plain, F.col("embedding")).otherwise(F.transform("embedding", lambda x: x / F.col("largest")))
    rows = vectors.select("vec_id", numbers.alias("embedding")).select(
        "vec_id", F.when(valid, F.col("embedding")).alias("embedding")
    ).withColumn("largest", largest).select("vec_id", sized.alias("embedding")).select(
        "vec_id", "embedding", F.size("embedding").alias("dims"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(17), "embedding").alias("h2"),
    )
    folded = cut_lineage(
        rows.filter("embedding IS NOT NULL").groupBy("dims", "h1", "h2")
        .agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    )
    total = folded.count()
    main = folded.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if main is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = main[0]
    picked = folded.filter(F.col("dims") == dims).orderBy("h1", "h2").limit(sample).select("embedding").toPandas()
    fitted = np.array(picked["embedding"].tolist(), dtype=np.float64)
    fitted /= np.linalg.norm(fitted, axis=1, keepdims=True)
    sent = spark.sparkContext.broadcast(spherical_kmeans(fitted, max(1, min(MAX_CELLS, total // per_cell))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return assigned(batches, sent.value, margin)

    usual = folded.filter(F.col("dims") == dims).select("vec", "weight", "embedding").mapInArrow(assign, VISITS)
    # Vectors of another length have one cell per length.
    other = folded.filter(F.col("dims") != dims).select(
        "vec", "weight", (-F.col("dims")).alias("home"), F.array().cast("array<int>").alias("visits"), "embedding"
    )
    placed = cut_lineage(usual.unionByName(other))
    block_of = lambda n: F.pmod(F.xxhash64("vec"), F.ceil(F.col(n) / BLOCK)).cast("int")
    at_home = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("homes"))
    homes = placed.withColumn("cell", F.col("home")).join(at_home, "cell").withColumn("block", block_of("homes"))
    blocks = F.ceil(F.col("homes") / BLOCK).cast("int")
    met = (
        homes.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
        .withColumn("side", (F.col("block") != F.col("i")).cast("int"))
        .withColumn("guests", F.lit(False))
    )
    visitors = placed.withColumn("cell", F.explode("visits"))
    visiting = visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("visitors"))
    guest_blocks = F.ceil(F.col("visitors") / BLOCK).cast("int")
    hosts = (
        homes.join(visiting, "cell").withColumn("i", F.col("block"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), guest_blocks - 1)))
        .withColumn("side", F.lit(0)).withColumn("guests", F.lit(True))
    )
    guests = (
        visitors.join(visiting, "cell").join(at_home, "cell").withColumn("j", block_of("visitors"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("side", F.lit(1)).withColumn("guests", F.lit(True))
    )
    columns = ["cell", "i", "j", "guests", "side", "vec", "weight", "home", "visits", "embedding"]
    tasks = met.select(*columns).unionByName(hosts.select(*columns)).unionByName(guests.select(*columns))

    def compared(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return compare(key, part, threshold)

    found = cut_lineage(tasks.groupBy("cell", "i", "j", "guests").applyInPandas(compared, FOUND))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("n"))
    grown = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "vec")
    classes = (
        folded.join(links, "vec", "left").join(grown, "vec", "left")
        .select(
            "dims", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "vec").alias("component_id"),
        )
    )
    out = rows.drop("embedding").join(classes, ["dims", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v WHERE e IS NOT NULL),
u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
      AND list_dot_product(a.e, b.e) >= 0.95 * a.size * b.size AND a.size > 0 AND b.size > 0),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op4_vector_dedup", ORACLE)
def op4_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its links and its group's representative."""
    return near_duplicate_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
