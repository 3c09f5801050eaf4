"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from vitalgrid.llm import whitening
from vitalgrid.llm.whitening import Spectrum, Whitening, add_rows, whiten

SCHEMA = "vec_id long, embedding array<double>, x string, part int, n int, component int, values int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def spectra():
    rng = np.random.default_rng(1)
    yield rng.normal(size=(300, 24))
    yield rng.normal(size=(300, 24)) * 10.0 ** rng.uniform(-6, 2, 24)
    yield rng.integers(-1, 2, (200, 24)).astype(float)
    yield np.repeat(rng.normal(size=(3, 24)), 60, axis=0)
    yield np.eye(24)[rng.integers(0, 24, 100)] * 3
    yield np.zeros((4, 24))
    yield np.full((9, 1), 2.0)


@pytest.mark.parametrize("case", range(7))
@pytest.mark.parametrize("block", [1, 64])
def test_rank_one_updates(case, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    y = list(spectra())[case]
    held = Spectrum.empty(y.shape[1])
    add_rows(held, y)
    want = y.T @ y
    scale = max(np.abs(want).max(), 1e-300)
    assert np.abs(held.vectors.T @ held.vectors - np.eye(y.shape[1])).max() < 1e-12
    assert np.abs(held.values - np.linalg.eigvalsh(want)).max() / scale < 1e-12
    assert np.abs(held.vectors * held.values @ held.vectors.T - want).max() / scale < 1e-12


def plain(rows, components):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dims = min(set(lengths), key=lambda d: (-lengths.count(d), d))
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == dims]
    n, s = len(good), [sum(v[j] for _, v in good) for j in range(dims)]
    top = [[n * a - b for a, b in zip(v, s, strict=True)] for _, v in good]
    y = np.array(top, float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > dims * 2.3e-16 * values[order[0]]][:components]
    white = y @ vectors[:, order] / np.sqrt(values[order])
    return {
        (i, tuple(v)): (sum(a * a for a in t), w, values[order] / values.sum()) for (i, v), t, w in zip(good, top, white, strict=True)
    }, n


def compared(spark, rows, components=32):
    """The operator's rows by vec_id, signs brought into line with the plain version."""
    want, n = plain(rows, components)
    got = whiten(table(spark, rows), components).collect()
    k = len(next(iter(want.values()))[1])
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    white = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        white.setdefault(r.vec_id, {})[r.component] = r
    for (i, _), (deviation, w, explained) in want.items():
        mine = white[i]
        assert {r.deviation for r in mine.values()} == {deviation if deviation < 2**63 else None}
        assert np.allclose([mine[c + 1].explained for c in range(k)], explained, rtol=1e-9)
        assert np.allclose([abs(mine[c + 1].whitened) for c in range(k)], abs(w), atol=1e-6)
    signs = np.sign([[white[i][c + 1].whitened * w[c] for c in range(k)] for (i, _), (_, w, _) in want.items() if abs(w).min() > 1e-3])
    assert (signs == signs[0]).all()


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    compared(spark, rows)


def test_many_tasks_and_merges(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(400)]
    want, n = plain(rows, 4)
    got = whiten(table(spark, rows, 7), 4).collect()
    assert len(got) == 4 * n
    one = {r.vec_id: abs(r.whitened) for r in got if r.component == 1}
    assert all(abs(one[i] - abs(w[0])) < 1e-9 for (i, _), (_, w, _) in want.items())


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    rows += [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [math.nan, 0.0, 0.0]), (54, [0.0, -math.inf, 0.0]), (55, [1.0, 2.0]), (56, [0.0, 0.0, 0.0])]
    compared(spark, rows)
    compared(spark, [(i, [x, x, -x]) for i, (x, _, _) in rows[:30]])
    # A third of all rows are one vector; an id may repeat or be null.
    hot = rows[:30] + [(99, [0.5, 0.25, 0.125])] * 15 + [(None, [1.0, 0.0, 0.0])] * 2
    got = whiten(table(spark, hot)).collect()
    assert len(got) == 3 * 47 and sum(r.vec_id is None for r in got) == 6 and max(r.identity_error for r in got) < 1e-9
    assert len({r.whitened for r in got if r.vec_id == 99 and r.component == 1}) == 1


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        out = whiten(table(spark, rows))
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_large_numbers_stay_exact():
    model = Whitening(3, [2**60, 5], np.eye(2), np.ones(2), 1.0)
    x = np.array([[2**61, 1], [7, 2]])
    assert model.numerators(x).tolist() == [[3 * 2**61 - 2**60, -2], [21 - 2**60, 1]]
    assert model.deviations(x).to_pylist() == [None, None]
    assert model.deviations(np.array([[2**60 // 3, 0]])).to_pylist() == [(3 * (2**60 // 3) - 2**60) ** 2 + 25]
