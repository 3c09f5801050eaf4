"""Features and output handling of the readiness and stress models; the models themselves stay outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spelled-out stress levels. Fixed values.
STRESS_LEVELS = {
    "none": 0, "None": 0, "low": 1, "Low": 1, "moderate": 2, "Moderate": 2, "high": 3, "High": 3,
    "very high": 4, "Very High": 4,
}
MODERATE = 2
FEATURES = ["hr_mean", "hr_std", "rmssd", "temp_mean"]
REQUIRED = ["hr_mean", "rmssd", "temp_mean"]
POPULATION = "_population"
EPSILON = 1e-8


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def readiness_features(rows: DataFrame) -> DataFrame:
    """Reject reason, or six float features in training order.

    heart_rate, stress_level and blood_oxygen must be present and not zero or
    empty; the remaining inputs default to 0.
    """
    level = F.col("stress_level")
    reason = (
        F.when(
            (_zero("heart_rate") == 0) | (F.coalesce(level, F.lit("")) == "") | (_zero("blood_oxygen") == 0), "invalid_request"
        )
        .when(~F.col("heart_rate").between(30, 300), "heart_rate")
        .when(~_zero("sleep_duration").between(0, 24), "sleep_duration")
        .when(~F.col("blood_oxygen").between(50, 100), "blood_oxygen")
        .when(_zero("steps") < 0, "steps")
        .when(_zero("calories_burned") < 0, "calories_burned")
    )
    table = F.create_map(*[F.lit(x) for pair in STRESS_LEVELS.items() for x in pair])
    vector = F.array(
        F.col("heart_rate").cast("float"),
        _zero("sleep_duration").cast("float"),
        F.coalesce(F.try_element_at(table, level), F.lit(MODERATE)).cast("float"),
        F.least(F.greatest(F.col("blood_oxygen"), F.lit(85.0)), F.lit(100.0)).cast("float"),
        F.log1p(F.greatest(_zero("steps"), F.lit(0.0))).cast("float"),
        F.log1p(F.greatest(_zero("calories_burned"), F.lit(0.0))).cast("float"),
    )
    return rows.withColumn("reason", reason).withColumn("features", F.when(F.col("reason").isNull(), vector))


def clip_scores(preds: DataFrame, column: str = "score") -> DataFrame:
    """Model output held within [0, 100]; a failed prediction stays null."""
    bounded = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(100.0))
    return preds.withColumn(column, F.when(F.col(column).isNotNull(), bounded))


def stress_labels(preds: DataFrame) -> DataFrame:
    """label_name ('Stress' for 2, else 'Baseline') and the two probabilities by name."""
    return preds.withColumn("label_name", F.when(F.col("label") == 2, "Stress").otherwise(F.lit("Baseline"))).select(
        *[c for c in preds.columns if c != "probabilities"],
        "label_name",
        F.try_element_at("probabilities", F.lit(1)).cast("double").alias("prob_baseline"),
        F.try_element_at("probabilities", F.lit(2)).cast("double").alias("prob_stress"),
    )


def calibrate_norms(windows: DataFrame) -> DataFrame:
    """(subject, feature, mean, std) from baseline windows: user_id and the four features.

    All eight statistics come from one aggregation; rows per feature are
    written from its result, not from the input.
    """
    stats = windows.groupBy(F.col("user_id").alias("subject")).agg(
        *[F.avg(f).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"{f}_m").alias("mean"), (F.col(f"{f}_s") + F.lit(EPSILON)).alias("std")
            )
            for f in FEATURES
        ]
    )
    return stats.select("subject", F.explode(entries).alias("e")).select("subject", "e.feature", "e.mean", "e.std")


def stress_features(windows: DataFrame, user_norms: DataFrame, population: DataFrame) -> DataFrame:
    """z-scores of a window with the user's norm as a whole, or the population's.

    A user's own norm is never filled up from the population: a feature missing
    in it is an error, as is a window without the required inputs.
    """
    pair = F.struct("mean", "std")
    own = user_norms.groupBy(F.col("subject").alias("user_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", pair.alias("s")))).alias("own")
    )
    # one subject with four features
    shared = (
        population.filter(F.col("subject") == POPULATION)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", pair.alias("s")))).alias("n"))
        .scalar()
    )
    joined = windows.join(own, "user_id", "left").withColumn("norm", F.coalesce("own", shared))
    bad_input = F.lit(False)
    for f in REQUIRED:
        bad_input = bad_input | (_zero(f) == 0)
    missing = F.lit(False)
    for f in FEATURES:
        missing = missing | F.try_element_at("norm", F.lit(f)).isNull()
    z = [
        ((_zero(f) - F.try_element_at("norm", F.lit(f))["mean"]) / F.try_element_at("norm", F.lit(f))["std"]).cast("float")
        for f in FEATURES
    ]
    reason = F.when(bad_input, "invalid_request").when(
        F.col("norm").isNull() | (F.size("norm") == 0), "norms_not_loaded"
    ).when(missing, "norm_missing")
    return (
        joined.withColumn("reason", reason)
        .withColumn("calibrated", F.col("own").isNotNull())
        .withColumn("features", F.when(F.col("reason").isNull(), F.array(*z)))
        .drop("own", "norm")
    )
