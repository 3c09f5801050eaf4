"""The pipeline's stages, each against a plain version on what the stage before kept."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_text_dedup import FOLD, WHITE, plain_components, plain_spans, sha

from vitalgrid.llm.quality import fit_quality, score_quality
from vitalgrid.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut_lineage(stage(spark, docs, FOLDER))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].dtypes == kept["documents"].dtypes
        if name != "quality":
            assert kept[name].filter(F.char_length("text") != F.col("n_chars")).count() == 0


def test_quality(kept, spark):
    model = fit_quality(kept["documents"], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in score_quality(kept["documents"], model).collect() if r.score >= 0.5}
    assert texts(kept["quality"]) == [x for x in texts(kept["documents"]) if x[0] in good]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(i in good for i, q in labels.items() if q == 1)


def test_lines(kept):
    rows = texts(kept["quality"])
    key = lambda line: line.strip(WHITE).translate(FOLD)
    held = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(i)
    want = [
        (i, "\n".join(x for x in text.split("\n") if len(held[key(x)]) < 2 or min(held[key(x)]) == i)) for i, text in rows
    ]
    assert texts(kept["line_dedup"]) == want


def test_near_duplicates(kept):
    rows = texts(kept["line_dedup"])
    stay = {i for i, _, component in plain_components(rows) if i == component}
    assert texts(kept["near_duplicates"]) == [x for x in rows if x[0] in stay]


def test_passages(kept):
    rows = texts(kept["near_duplicates"])
    want = {r[0]: r for r in plain_spans(rows)}
    for i, text in texts(kept["suffix_dedup"]):
        assert len(text.encode()) <= want[i][1] - want[i][2]
        if dict(rows)[i].isascii():
            assert sha(text) == want[i][4]


def test_sequences(kept):
    pieces = kept["packing"].toPandas()
    assert set(pieces["doc_id"]) == {i for i, _ in texts(kept["suffix_dedup"])}
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 1024
    whole = pieces.groupby("doc_id").agg(n=("length", "sum"), all=("doc_tokens", "max"))
    assert (whole["n"] == whole["all"]).all()
    assert re.fullmatch(r"u?int\d+", str(pieces["ids_crc32"].dtype))
