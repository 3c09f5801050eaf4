"""Quality ranking, vectors and chats."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from cases import AWKWARD
from pyspark.sql import functions as F

from vitalgrid.llm import vector_dedup
from vitalgrid.llm.chat_format import canonical_turns, format_chats, read_chats
from vitalgrid.llm.quality import best_quantile, bradley_terry, fit_quality, held_out, score_quality
from vitalgrid.llm.vector_dedup import near_duplicate_vectors

DATA = "/root/testdata/sf0.01"


def test_ranking_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    good = x[:, 0] - 0.5 * x[:, 1] > 0.3
    model = bradley_terry(x, good, pairs=5000)
    assert ((model.scores(x) >= 0.5) == good).mean() > 0.95
    assert abs(model.weights[2]) < abs(model.weights[0]) / 4
    assert (bradley_terry(x, np.ones(400, bool)).scores(x) == 0.5).all()


def test_cut_parts_the_labels():
    assert best_quantile(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])) == 1.5
    assert best_quantile(np.array([1.0, 1.0, 2.0]), np.array([False, False, True])) == 1.5


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    rows = scored.select("predicted", "quality").collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_scores_of_awkward_texts(documents, spark):
    docs = documents(AWKWARD)
    labels = spark.createDataFrame([(4, 1), (6, 1), (15, 0), (None, 1), (18, None), (17, 0), (4, 1)], "doc_id long, quality int")
    rows = score_quality(docs, fit_quality(docs, labels), carry=["text", "n", "gram"]).collect()
    assert len(rows) == len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.gram == "g" for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert score_quality(documents([]), fit_quality(documents([]), labels)).count() == 0


def plain_vectors(rows):
    good = [
        (i, np.array(v, float)) for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    unit = [v / np.linalg.norm(v) for _, v in good]
    pairs = [
        (a, b) for a in range(len(good)) for b in range(len(good))
        if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ]
    label = {k: good[k][0] for k in range(len(good))}
    for _ in range(len(good)):
        for a, b in pairs:
            label[a] = min(label[a], label[b])
    links = {k: 0 for k in range(len(good))}
    for a, _ in pairs:
        links[a] += 1
    known = {good[k][0]: (good[k][0], links[k], label[k], label[k] == good[k][0]) for k in range(len(good))}
    return sorted(known.get(i, (i, 0, i, True)) for i, _ in rows)


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * s).tolist()) for k, s in enumerate((0, 0, 0.05, 0.1, 0.15, 0.2))]
    n = len(rows)
    rows += [
        (n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [1.0, None]), (n + 5, [float("inf")] * 16),
        (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, rows[0][1]),
    ]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, weight int, home int")
    got = near_duplicate_vectors(table, per_cell=8)
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == plain_vectors(rows)
    assert near_duplicate_vectors(table.limit(0)).count() == 0
    assert near_duplicate_vectors(table.filter("embedding IS NULL")).collect()[0].n_links == 0


def test_recall_with_many_cells(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = {r[0]: r[1] for r in plain_vectors(rows)}
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(table, per_cell=25).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


CHATS = [
    (1, 0, "system", "be [brief] </s>"), (1, 1, "user", "[INST] hi <<SYS>>"), (1, 2, "assistant", "</s> [ROLE] x [/ROLE] <.<"),
    (1, 3, "assistant", ""), (2, 0, "tool [/ROLE] <", "out"), (2, 1, None, None), (2, None, "user", "first\nline"), (None, 0, "assistant", "é日"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 5, "assistant", "word " * 20_000),
]


def test_chats_round_trip(spark):
    table = spark.createDataFrame([(*r, 1, "p") for r in CHATS], "conv_id long, turn long, role string, text string, at int, piece string")
    rows = {r.conv_id: r for r in read_chats(format_chats(table)).collect()}
    order = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in (1, 2, 3, 4, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in CHATS if r[0] == conv), key=order)]
        assert [tuple(t) for t in rows[conv].turns] == turns
        assert list(rows[conv].loss_texts) == [t for role, t in turns if role == "assistant"]
    assert read_chats(format_chats(table.limit(0))).count() == 0


def test_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}], "id": 9}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}'),
        (3, '{"prompt": "p", "completion": "c"}'), (4, '{"instruction": "i", "input": "", "output": "o"}'),
        (5, '{"instruction": "i", "input": "n", "output": "o", "extra": {"prompt": 1}}'), (6, '{"instruction": "i", "output": "o"}'),
        (7, "{broken"), (8, None), (9, '{"messages": []}'), (10, '{"system": "s", "prompt": "p", "response": "r"}'), (11, "[1]"),
    ]
    table = spark.createDataFrame([(*r, 5, "x") for r in records], "conv_id long, record string, turn int, layout string")
    got = {}
    for r in canonical_turns(table).orderBy("conv_id", "turn").collect():
        got.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    nothing = [(None, None)]
    assert got == {
        (1, "messages"): [("user", "a"), ("assistant", "")], (2, "shared"): [("user", "q"), ("assistant", "r")],
        (3, "completion"): [("user", "p"), ("assistant", "c")], (4, "instruction_input"): [("user", "i"), ("assistant", "o")],
        (5, "instruction_input"): [("user", "i\n\nn"), ("assistant", "o")], (6, "instruction"): [("user", "i"), ("assistant", "o")],
        (7, None): nothing, (8, None): nothing, (9, None): nothing, (11, None): nothing,
        (10, "system_response"): [("system", "s"), ("user", "p"), ("assistant", "r")],
    }
    assert canonical_turns(table.limit(0)).count() == 0


def test_format_is_the_documented_one(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u[1]"), (1, 2, "assistant", "a<b"), (1, 3, "tool", "t")]
    chat = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert chat.formatted == "<<SYS>> s <</SYS>>[INST] u[.1] [/INST]a<.b </s>[ROLE] tool [/ROLE] t </s>"
    assert [tuple(s) for s in chat.loss_spans] == [(chat.formatted.index("a<.b"), 4)]
    assert hashlib.sha256(b"").hexdigest()


def test_very_long_turns_stay_whole(spark):
    long = "a<" * 10_500_000
    records = spark.createDataFrame(
        [(1, '{"turns":[{"role":"assistant","text":"%s"}]}' % long), (2, '{"prompt":"%s","response":"b"}' % long)], "conv_id long, record string"
    )
    turns = canonical_turns(records)
    chats = read_chats(format_chats(turns)).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"], F.char_length(t["text"]), F.crc32(t["text"]))).alias("turns"),
        F.transform("loss_texts", F.char_length).alias("loss"),
    )
    crc = zlib.crc32(long.encode())
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in chats.collect()}
    assert got == {
        1: ([("assistant", 21_000_000, crc)], [21_000_000]),
        2: ([("user", 21_000_000, crc), ("assistant", 1, zlib.crc32(b"b"))], [1]),
    }


def test_vectors_of_extreme_lengths(spark):
    rows = [
        (1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [5e-324, 1e-323]), (6, [1.0, 2.0]),
        (7, [-1.7e308, 1.7e308]), (8, [-3.0, 3.0]), (9, [0.0, 0.0]), (10, [-0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(table).collect()}
    assert got == {
        1: (3, 1), 2: (3, 1), 5: (3, 1), 6: (3, 1), 3: (1, 3), 4: (1, 3), 7: (1, 7), 8: (1, 7), 9: (0, 9), 10: (0, 10),
    }
