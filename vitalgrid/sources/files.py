"""File sources outside the table store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_IMAGE_BYTES = 20 * 1024 * 1024
NORMS = "map<string,map<string,struct<mean:double,std:double>>>"


def norm_stats(texts: DataFrame, column: str = "text") -> DataFrame:
    """(subject, feature, mean, std) out of nested JSON maps; subject '_population' is the fallback."""
    return (
        texts.select(F.explode(F.from_json(column, NORMS)).alias("subject", "features"))
        .select("subject", F.explode("features").alias("feature", "s"))
        .select("subject", "feature", "s.mean", "s.std")
    )


def load_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    return norm_stats(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def image_intake_audit(files: DataFrame) -> DataFrame:
    """Verdict per uploaded file (path, content, length): JPEG or PNG of 4 bytes to 20 MB."""
    head = F.hex(F.substring("content", 1, 4))
    is_image = head.startswith("FFD8") | (head == "89504E47")
    return files.select(
        "path",
        "length",
        F.when(F.col("length") == 0, "empty_file")
        .when(F.col("length") < 4, "file_too_small")
        .when(~is_image, "unsupported_type")
        .when(F.col("length") > MAX_IMAGE_BYTES, "file_too_large")
        .otherwise("ok")
        .alias("verdict"),
    )


def load_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
