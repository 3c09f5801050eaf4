"""Quality classifier: Bradley-Terry ranking over text statistics, cut at a score quantile.

Preference pairs (a good document, a bad one) are drawn from labelled rows. The
model gives every document a strength ``w . x``; the chance that the good one
wins is the logistic function of the difference, and ``w`` minimises the
logistic loss on the feature differences. The cut is the quantile of the
training strengths that parts the two labels best.

Fitting uses at most ``MAX_PER_CLASS`` labelled rows of each label (those with
the smallest id hashes) and ``PAIRS`` pairs, so what reaches the driver is
bounded. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of
from vitalgrid.llm.registry import query
from vitalgrid.llm.text_stats import NAMES, text_features

MAX_PER_CLASS = 5_000
PAIRS = 60_000
STEPS = 200
L2 = 1e-2
FARTHEST = 8.0


def standardised(features: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """In units of the spread, ``FARTHEST`` at most, so that one rare sign alone decides nothing."""
    return np.clip((features - mean) / spread, -FARTHEST, FARTHEST)


@dataclass(frozen=True)
class RankModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def strengths(self, features: np.ndarray) -> np.ndarray:
        return standardised(features, self.mean, self.spread) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the cut."""
        return 1.0 / (1.0 + np.exp(-np.clip((self.strengths(features) - self.cut) / self.scale, -30, 30)))


def bradley_terry(features: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> RankModel:
    """Fit on labelled rows. Without a row of either label every score is 0.5."""
    width = features.shape[1] if features.ndim == 2 else len(NAMES)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(winners) or not len(losers):
        return RankModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = standardised(features, mean, spread)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(winners, pairs)] - z[rng.choice(losers, pairs)]
    weights, speed = np.zeros(width), np.zeros(width)
    for _ in range(STEPS):
        lost = 1.0 / (1.0 + np.exp(np.clip(diff @ weights, -30, 30)))
        speed = 0.8 * speed + diff.T @ lost / pairs - L2 * weights
        weights = weights + 0.5 * speed
    strengths = z @ weights
    cut = best_quantile(strengths, good)
    return RankModel(mean, spread, weights, cut, float(strengths.std()) or 1.0)


def best_quantile(strengths: np.ndarray, good: np.ndarray) -> float:
    """Cut at the quantile with the highest balanced accuracy; halfway between the two scores it parts."""
    order = np.argsort(strengths, kind="stable")
    s, g = strengths[order], good[order]
    below_bad, below_good = np.cumsum(~g), np.cumsum(g)
    right = below_bad / below_bad[-1] + 1.0 - below_good / below_good[-1]
    right[:-1][s[:-1] == s[1:]] = -1.0  # equal scores stay together
    at = int(np.argmax(right[:-1])) if len(s) > 1 else 0
    return float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(list(text_features(batch.column(1))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["good", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> RankModel:
    """Model from the labelled rows that are not held out; rows with a null id or label are left aside."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    spread = F.xxhash64("doc_id")
    picked = None
    for value in (0, 1):
        part = (
            known.filter(F.col("quality") == value).select("doc_id", (F.col("quality") == 1).alias("good")).distinct()
            .orderBy(spread, "doc_id").limit(max_per_class)
        )
        picked = part if picked is None else picked.unionByName(part)
    # The sample is bounded, so it may be sent to every task.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("good", "text")
    rows = texts.mapInArrow(feature_rows, "good boolean, features array<double>").collect()
    features = np.array([r["features"] for r in rows]).reshape(len(rows), len(NAMES))
    good = np.array([r["good"] for r in rows], bool)
    order = np.lexsort((*features.T, good))  # the fit does not depend on the order of arrival
    return bradley_terry(features[order], good[order])


def score_quality(docs: DataFrame, model: RankModel, carry: list[str] = ()) -> DataFrame:
    """doc_id, score, predicted, and the ``carry`` columns; one row per input row.

    Null and empty texts are scored as empty texts. Only the text is an input of
    the score. An empty table gives no rows.
    """
    kinds = dict(docs.dtypes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(text_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *[batch.column(i) for i in places]],
                names=["doc_id", "score", "predicted", *[f"with_{c}" for c in carry]],
            )

    # The text goes to the tasks once, also where it is carried.
    rest = [c for c in carry if c != "text"]
    places = [1 if c == "text" else 2 + rest.index(c) for c in carry]
    base = docs.select("doc_id", F.col("text").alias("scored_text"), *[F.col(c).alias(f"with_{c}") for c in rest])
    extra = "".join(f", `with_{c}` {kinds[c]}" for c in carry)
    out = base.mapInArrow(scored, f"doc_id {kinds['doc_id']}, score double, predicted int{extra}")
    return out.select("doc_id", "score", "predicted", *[F.col(f"with_{c}").alias(c) for c in carry])


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score, learned without the held-out third."""
    docs = documents_of(spark, folder)
    model = fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
