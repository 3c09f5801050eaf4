"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from vitalgrid.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q int, row string, dims int, anchor long, slot int, score int, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def plain(rows, every=2, positives=5, negatives=3):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, tuple(int(max(-(2**53), min(2**53, math.floor(256 * x) if abs(256 * x) < 1e300 else math.copysign(2**53, x)))) for x in v), label)
        if row not in kept:
            kept.append(row)
    out = []
    for i, v, label in kept:
        if i % every:
            continue
        scored = []
        for j, w, other in kept:
            if len(w) == len(v):
                scored.append((max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j, other))
        scored.sort(key=lambda x: (-x[0], x[1]))
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s][:negatives]
            out += [(i, p, r + 1, n, s, t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_vectors_in_small_blocks(spark, monkeypatch, seed):
    for name, value in (("ANCHORS", 4), ("ROWS", 6), ("STEP", 3), ("LEVEL", 2)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(seed)
    # Few distinct values: many ties and equal limits.
    rows = [(i, (rng.integers(-2, 3, 4) / 8).tolist(), int(rng.integers(0, 3))) for i in range(70)]
    want = plain(rows)
    assert len(want) > 60 and found(hn.hard_negatives(table(spark, rows), every=2)) == want


def test_awkward_rows(spark):
    base = [0.5, 0.25, -0.125]
    rows = [
        (0, base, 1), (0, base, 1), (0, [0.4, 0.2, 0.0], 1), (2, base, 1), (3, base, 2), (4, [0.3, 0.2, 0.0], 2), (6, [], 1), (8, [], 2), (8, [], 1),
        (10, None, 1), (12, [1.0, None, 0.0], 1), (14, [math.nan, 0.0, 0.0], 1), (16, [math.inf, 0.0, 0.0], 2), (18, base, None), (None, base, 2),
        (20, [0.0, 0.0, 0.0], 3), (22, [0.0, 0.0, 0.0], 3), (24, [0.5, 0.25], 1), (26, [0.5, 0.25], 1), (27, [0.3, 0.2], 2),
        (28, [1e300, 1.0, 0.0], 4), (30, [1e300, 2.0, 0.0], 4), (31, [2e6, 1.0, 0.0], 5), (33, [1.7e308, -1.0, 0.0], 5), (35, [7e8, 1e5, 0.0], 5),
    ]
    want = plain(rows)
    got = found(hn.hard_negatives(table(spark, rows), every=2))
    assert got == want and want


def test_nothing_to_mine(spark):
    assert found(hn.hard_negatives(table(spark, []))) == []
    assert found(hn.hard_negatives(table(spark, [(50, [1.0], 1), (1, [0.9], 1), (2, [0.7], 1)]))) == []
    assert found(hn.hard_negatives(table(spark, [(50, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]))) == [(50, 1, 1, 2, 65536, 256 * 179)]


def test_scores_stay_exact():
    big = np.array([[2.0**40, 3.0, 1.0]])
    other = np.array([[2.0**20, 1.0, 1.0], [2.0**40, 1.0, 1.0]])
    assert hn.scores(big, other).tolist() == [[2**60 + 4, 2**63 - 1]]
    assert hn.scores(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0, 0, 0]] * 2
