"""Source mixing against plain versions."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import AWKWARD

from vitalgrid.llm import source_mix
from vitalgrid.llm.source_mix import fit_lengths, knapsack, mix_sources

SCHEMA = "doc_id long, text string, source string, size int, target string, h int, n int, at int, s string, cut int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "t", 2, 3, 4, "s", 5) for r in rows], SCHEMA).repartition(parts)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = [s for s in order if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in left)
        share = {s: weight[s] * rest / total for s in left}
        above = [s for s in left if share[s] > cap * sizes[s]]
        if not above:
            return {**{s: float(v) for s, v in fixed.items()}, **share}
        fixed |= {s: cap * sizes[s] for s in above}


def checked(df, rows):
    """Holds the mix against what it must be; returns |taken - target| per source."""
    got = df.collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    taken, target = Counter(), {}
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        assert r.target == want[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    # Copies of a source's documents differ by one at most.
    copies = defaultdict(set)
    for r in got:
        if r.size:
            copies[r.source].add(r.taken // r.size)
    assert all(max(c) - min(c) <= 1 for c in copies.values())
    return {s: abs(taken[s] - target[s]) for s in target}


def test_knapsack_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.permutation(np.arange(1, 12))[: rng.integers(1, 5)]
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 40))
        taken, rest = knapsack(lengths, counts, budget)
        sums = {sum(a * b for a, b in zip(p, lengths, strict=True)) for p in itertools.product(*[range(c + 1) for c in counts])}
        assert abs(rest) == min(abs(budget - s) for s in sums)
        assert (taken <= counts).all() and (taken * lengths).sum() == budget - rest


def test_lengths_fill_a_large_budget():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(0, 20_000, 3_000))
    counts = rng.integers(1, 900, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        taken = fit_lengths(lengths, counts, budget)
        assert (taken <= counts).all() and abs((taken * lengths).sum() - min(budget, total)) <= lengths[lengths > 0].min()
    # Every length gives its share: the mix is not made of long or short documents.
    taken = fit_lengths(lengths, counts, total // 3)
    assert abs(taken - counts / 3).max() < 80 and abs(taken - counts / 3).mean() < 1.5
    assert (fit_lengths(np.array([0]), np.array([9]), 5) == 0).all()
    assert fit_lengths(np.array([7, 10**6]), np.array([1, 3]), 10**6 + 7).tolist() == [1, 1]


@pytest.mark.parametrize("per_range", [3, 8192])
def test_many_documents(spark, monkeypatch, per_range):
    monkeypatch.setattr(source_mix, "PER_RANGE", per_range)
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 9)), f"s{int(rng.integers(0, 3)) ** 2}") for i in range(400)]
    rows += [(1000 + i, "a b c", "hot") for i in range(300)]
    off = checked(mix_sources(table(spark, rows), carry=["source"]), rows)
    assert off.pop("hot") <= 1.5 and max(off.values()) <= 0.5  # all of one length there
    first = sorted(map(str, mix_sources(table(spark, rows)).collect()))
    assert first == sorted(map(str, mix_sources(table(spark, rows, 5)).collect()))


def test_awkward_rows(spark):
    sources = itertools.cycle(["b", "a", None, "é", "", "B"])
    rows = [(i, t, s) for (i, t), s in zip(AWKWARD, sources)]
    rows += [(77, "one two three", "hot")] * 40 + [(None, "x y", "hot")] * 30 + [(5, None, "void"), (6, " \n", "void")]
    out = mix_sources(table(spark, rows), carry=["source", "text", "h", "at"])
    off = checked(out, rows)
    assert off["hot"] <= 1.5 and off["void"] == 0
    assert {(r.h, r["at"]) for r in out.collect()} == {(2, 4)}


def test_repeated_rows_are_parted(spark):
    rows = [(1, "a b", "x")] * 50 + [(2, "c d e f", "y")] * 20 + [(3, "z", "z")] * 9
    off = checked(mix_sources(table(spark, rows), carry=["source"]), rows)
    assert max(off.values()) <= 2


def test_empty_tables(spark):
    assert mix_sources(table(spark, [])).collect() == []
    rows = [(1, None, "a"), (2, "", None)]
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mix_sources(table(spark, rows)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
