"""Queries: model features and outputs, norms, tables."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators import scoring
from vitalgrid.plans.registry import query
from vitalgrid.session import checkpoint_dir
from vitalgrid.sources import files
from vitalgrid.sources.tables import load_tables

# Windows from embeddings: the label is the user, the first four elements the features.
WINDOWS = """SELECT vec_id, CAST(label AS BIGINT) AS user_id, CAST({e}1{x} AS DOUBLE) AS hr_mean, CAST({e}2{x} AS DOUBLE) AS hr_std, CAST({e}3{x} AS DOUBLE) AS rmssd, CAST({e}4{x} AS DOUBLE) AS temp_mean FROM embeddings"""
SPARK_WINDOWS = WINDOWS.replace("{e}", "element_at(embedding, ").replace("{x}", ")")
DUCK_WINDOWS = WINDOWS.replace("{e}", "embedding[").replace("{x}", "]")

NORMS = "SELECT user_id AS subject, f AS feature, AVG(v) AS mean, STDDEV_POP(v) + 1e-8 AS std FROM (UNPIVOT windows ON hr_mean, hr_std, rmssd, temp_mean INTO NAME f VALUE v) GROUP BY user_id, f"


def windows(ds):
    return ds.sql(SPARK_WINDOWS)


@query(
    "calibrate_norms",
    "SELECT subject, feature, ROUND(mean, 9) AS mean, ROUND(std, 9) AS std FROM norms",
    [],
    [("windows", DUCK_WINDOWS), ("norms", NORMS)],
)
def calibrate_norms(ds):
    out = scoring.calibrate_norms(windows(ds))
    return out.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(
    "stress_features",
    """SELECT w.vec_id, w.user_id, w.user_id % 3 <> 0 AS calibrated,
 ROUND(CAST((w.hr_mean - n1.mean) / n1.std AS DOUBLE), 4) AS f1, ROUND(CAST((w.temp_mean - n4.mean) / n4.std AS DOUBLE), 4) AS f4 FROM windows w
 JOIN used n1 ON n1.user_id = w.user_id AND n1.feature = 'hr_mean' JOIN used n4 ON n4.user_id = w.user_id AND n4.feature = 'temp_mean'""",
    [],
    [
        ("windows", DUCK_WINDOWS),
        ("norms", NORMS),
        ("everyone", "SELECT f AS feature, AVG(v) AS mean, STDDEV_POP(v) + 1e-8 AS std FROM (UNPIVOT windows ON hr_mean, hr_std, rmssd, temp_mean INTO NAME f VALUE v) GROUP BY f"),
        (
            "used",
            """SELECT n.subject AS user_id, n.feature, CASE WHEN n.subject % 3 = 0 THEN e.mean ELSE n.mean END AS mean, CASE WHEN n.subject % 3 = 0 THEN e.std ELSE n.std END AS std
 FROM norms n JOIN everyone e USING (feature)""",
        ),
    ],
)
def stress_features(ds):
    rows = windows(ds)
    own = scoring.calibrate_norms(rows).filter(F.col("subject") % 3 != 0)
    everyone = scoring.calibrate_norms(rows.withColumn("user_id", F.lit(scoring.POPULATION)))
    out = scoring.stress_features(rows, own, everyone)
    digit = lambda i: F.round(F.col("features")[i].cast("double"), 4)
    return out.select("vec_id", "user_id", "calibrated", digit(0).alias("f1"), digit(3).alias("f4"))


INPUTS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE 40 + value END AS heart_rate, CAST(event_id % 26 AS DOUBLE) AS sleep_duration,
 CASE event_id % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'very high' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'Low' WHEN 4 THEN 'high' ELSE 'moderate' END AS stress_level,
 CAST(48 + event_id % 55 AS DOUBLE) AS blood_oxygen, value * 100 AS steps, value - 2 AS calories_burned FROM events"""


@query(
    "readiness_features",
    """SELECT event_id, reason, CASE WHEN reason IS NULL THEN ROUND(heart_rate, 3) END AS f1, CASE WHEN reason IS NULL THEN CASE stress_level WHEN 'None' THEN 0 WHEN 'very high' THEN 4 WHEN 'HIGH' THEN 2
  WHEN 'Low' THEN 1 WHEN 'high' THEN 3 ELSE 2 END END::DOUBLE AS f3, CASE WHEN reason IS NULL THEN LEAST(GREATEST(blood_oxygen, 85), 100) END AS f4, CASE WHEN reason IS NULL THEN ROUND(CAST(CAST(LN(1 + steps) AS FLOAT) AS DOUBLE), 4) END AS f5
FROM (SELECT *, CASE WHEN heart_rate = 0 THEN 'invalid_request' WHEN heart_rate NOT BETWEEN 30 AND 300 THEN 'heart_rate' WHEN sleep_duration > 24 THEN 'sleep_duration'
 WHEN blood_oxygen NOT BETWEEN 50 AND 100 THEN 'blood_oxygen' WHEN calories_burned < 0 THEN 'calories_burned' END AS reason FROM inputs)""",
    [],
    [("inputs", INPUTS)],
)
def readiness_features(ds):
    out = scoring.readiness_features(ds.sql(INPUTS))
    digit = lambda i, n: F.round(F.col("features")[i].cast("double"), n)
    return out.select(
        "event_id", "reason", digit(0, 3).alias("f1"), digit(2, 0).alias("f3"), digit(3, 3).alias("f4"), digit(4, 4).alias("f5")
    )


@query(
    "clip_scores",
    "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN LEAST(GREATEST(value * 2 - 20, 0), 100) END AS score FROM events",
)
def clip_scores(ds):
    preds = ds.table("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") * 2 - 20).alias("score"))
    return scoring.clip_scores(preds)


@query(
    "stress_labels",
    "SELECT event_id, event_id % 4 AS label, CASE WHEN event_id % 4 = 2 THEN 'Stress' ELSE 'Baseline' END AS label_name, value / 1000 AS prob_baseline, 1 - value / 1000 AS prob_stress FROM events",
)
def stress_labels(ds):
    preds = ds.table("events").select(
        "event_id", (F.col("event_id") % 4).alias("label"),
        F.array(F.col("value") / 1000, 1 - F.col("value") / 1000).alias("probabilities"),
    )
    return scoring.stress_labels(preds)


@query(
    "load_norm_stats",
    "SELECT CAST(subject AS VARCHAR) AS subject, feature, ROUND(mean, 9) AS mean, ROUND(std, 9) AS std FROM norms",
    [],
    [("windows", DUCK_WINDOWS), ("norms", NORMS)],
)
def load_norm_stats(ds):
    """Norms written as files, one JSON map per subject, and read back."""
    norms = scoring.calibrate_norms(windows(ds))
    texts = norms.groupBy("subject").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std").alias("s")))).alias("f")
    ).select(F.to_json(F.create_map(F.col("subject").cast("string"), F.col("f"))).alias("text"))
    root = f"{checkpoint_dir(ds.spark).rstrip('/')}/norms-{uuid.uuid4().hex}"
    texts.withColumn("file", F.xxhash64("text")).write.partitionBy("file").text(root)
    out = files.load_norm_stats(ds.spark, root)
    return out.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


# Every table with its key.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


@query(
    "load_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, COUNT(*) AS n, COUNT(DISTINCT {k}) AS n_keys, CAST(SUM({k}) AS BIGINT) AS key_sum FROM {t}" for t, k in KEYS.items()
    ),
)
def load_tables_counts(ds):
    """Rows, keys and their sum of every table."""
    frames = [
        df.agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(KEYS[name]).alias("n_keys"),
            F.sum(KEYS[name]).cast("bigint").alias("key_sum"),
        )
        for name, df in load_tables(ds.spark, ds.folder, list(KEYS)).items()
    ]
    return reduce(DataFrame.unionByName, frames)
