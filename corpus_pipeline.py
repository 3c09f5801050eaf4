"""Corpus pipeline: quality, repeated lines, near duplicates, repeated passages, packing.

Every stage works on all rows the one before it kept and is written as Parquet
before the next reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of
from vitalgrid.llm.line_dedup import drop_repeated_lines
from vitalgrid.llm.packing import pack_documents, public_vocabulary
from vitalgrid.llm.quality import fit_quality, score_quality
from vitalgrid.llm.shingle_join import near_duplicates
from vitalgrid.llm.suffix_dedup import drop_repeated_bytes
from vitalgrid.session import configure, cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = ["lang", "source"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject; it learns from the labelled rows that are not held out."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, carry=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines an earlier document has; a document stays even where no line does."""
    out = drop_repeated_lines(docs, carry=CARRY).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    stay = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi").select(*COLUMNS)


def own_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand elsewhere; characters that a cut goes through are left out."""
    out = drop_repeated_bytes(docs, carry=CARRY).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 ids, with the ids' checksum."""
    out = pack_documents(docs, public_vocabulary("byte_bpe_50k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _configured(stage: Callable) -> Callable:
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES = [
    ("quality", _configured(good_documents)),
    ("line_dedup", _configured(own_lines)),
    ("near_duplicates", _configured(one_of_each_group)),
    ("suffix_dedup", _configured(own_passages)),
    ("packing", _configured(sequences)),
]

#: The classifier and the vocabulary have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents_of(configure(spark), sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
