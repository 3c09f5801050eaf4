"""Exact, line, near-duplicate and passage operators against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import AWKWARD, BASE

from vitalgrid.llm import shingle_join, suffix_dedup
from vitalgrid.llm.exact_dedup import exact_duplicates
from vitalgrid.llm.graph import components
from vitalgrid.llm.line_dedup import PerfectHash, drop_repeated_lines
from vitalgrid.llm.shingle_join import near_duplicates, similar_pairs
from vitalgrid.llm.suffix_dedup import drop_repeated_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
WHITE = " \t\n\v\f\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_lines(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(FOLD)
    order = lambda i: (i is not None, i)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 2 or min(held[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def plain_components(rows):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append((i, frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()))
    order = lambda i: (i is not None, i)
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                one, two = sorted((root(sets[a][0]), root(sets[b][0])), key=order)
                parent[two] = one
    return sorted(((i, len(s), root(i)) for i, s in sets), key=str)


def plain_spans(rows):
    texts = [(text or "").encode() for _, text in rows]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((i, len(t), int(mask.sum()), spans, sha(kept)))
    return sorted(out, key=str)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact(documents, keep):
    groups = defaultdict(list)
    for i, text in AWKWARD:
        groups[(text or "").translate(FOLD)].append(i)
    want = []
    for i, text in AWKWARD:
        norm = (text or "").translate(FOLD)
        ids = [x for x in groups[norm] if x is not None]
        stays = {"max": max, "min": min}[keep](ids) if ids else None
        want.append((i, stays, len(groups[norm]), i == stays, sha(norm)))
    for runs in (2, 100):
        df = exact_duplicates(documents(AWKWARD), keep=keep, fan_in=3, runs=runs)
        assert got(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)


def test_lines(documents):
    df = drop_repeated_lines(documents(AWKWARD), shard_keys=2, probes=3)
    assert got(df, "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(AWKWARD)


def test_lines_carry_clashing_columns(documents):
    df = drop_repeated_lines(documents([(1, "a long enough line"), (2, "a long enough line\nx")]), carry=["doc", "text", "with_text"])
    assert got(df, "doc_id", "kept_text", "doc", "text", "with_text") == [
        (1, "a long enough line", 1, "a long enough line", "w"), (2, "x", 1, "a long enough line\nx", "w"),
    ]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        high, low = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, n)
        index = PerfectHash.unpacked(*PerfectHash.build(high, low).packed())
        assert sorted(index.slots(high, low)) == list(range(n))


def edited_copies(seed, groups=6, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(6, 160))] + (shared if g % 2 else [])
        for _ in range(copies):
            new = list(words)
            for _ in range(rng.randint(0, 5)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(new)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(documents, seed, monkeypatch):
    rows = [(i, t) for i, t in AWKWARD if i != 10] + [(100 + i, t) for i, t in edited_copies(seed)]
    if seed == 2:  # many blocks, buckets and tasks, few counters
        for name, value in (("BLOCK", 3), ("BUCKET_POSTINGS", 50), ("TASK_SETS", 4), ("COUNTERS", 8), ("FREQUENT", 5)):
            monkeypatch.setattr(shingle_join, name, value)
    assert got(near_duplicates(documents(rows)), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def plain_links(rows):
    """Per row its number of links, and the linked pairs of different sets by their members' ids."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    counts = sorted((i, sum(near(sets[i], sets[j]) for j in sets if j != i)) for i in sets)
    return counts, {(i, j) for i in sets for j in sets if i != j and sets[i] != sets[j] and near(sets[i], sets[j])}


@pytest.mark.parametrize("small", [False, True])
def test_links_of_chains(documents, small, monkeypatch):
    words = [f"v{k}" for k in range(64)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 44])) for i in range(7)]  # each is linked with its neighbours only
    rows = [(i, t) for i, t in AWKWARD if i not in (None, 9, 10)]
    rows += [(50 + i, t) for i, t in chain] + [(60 + k, chain[k][1].upper()) for k in (0, 3)]
    rows += [(100 + i, t) for i, t in edited_copies(3)]
    if small:  # clusters in blocks, many of which overlap
        for name, value in (("BLOCK", 3), ("BUCKET_POSTINGS", 50), ("TASK_SETS", 4), ("COUNTERS", 8), ("FREQUENT", 5)):
            monkeypatch.setattr(shingle_join, name, value)
        monkeypatch.setattr(shingle_join, "drawn_together", lambda members: members)
    counts, linked = plain_links(rows)
    assert {(50, 51), (51, 52)} < linked and (50, 52) not in linked
    table = documents(rows)
    assert got(near_duplicates(table), "doc_id", "n_links") == sorted(counts, key=str)
    pairs, member = similar_pairs(table)
    found = got(pairs, "set_a", "set_b")
    assert len(found) == len(set(found))
    ids = defaultdict(list)
    for i, name in got(member, "doc_id", "set_id"):
        ids[name].append(i)
    joined = {(i, j) for a, b in found for i in ids[a] for j in ids[b]}
    assert joined | {(j, i) for i, j in joined} == linked


def test_ids_with_several_texts(documents):
    words = [f"u{k}" for k in range(200)]
    text = lambda k: " ".join(words[k : k + 44])
    rows = [(None, text(0)), (None, text(3)), (7, text(6)), (8, text(9))]  # a chain through two texts without id
    rows += [(20, text(60)), (30, text(60)), (30, text(120)), (25, text(120)), (30, ""), (26, text(123))]  # joined by id 30 only
    rows += [(40, "alone"), (40, None), (41, "")]
    df = near_duplicates(documents(rows))
    assert got(df, "doc_id", "n_shingles", "component_id") == plain_components(rows)
    counts = dict.fromkeys([7], 2) | {8: 1, 20: 1, 25: 2, 26: 2, 40: 0, 41: 0}
    assert {i: n for i, n in got(df, "doc_id", "n_links") if i in counts} == counts


def test_overlaps_follow_from_the_set_before():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 300, 60)
        sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 300, 60), base)).astype(np.uint64) for _ in range(12)]
        sets.sort(key=len)
        group = shingle_join.linked_groups(sets, np.zeros(12, int), False)
        want = np.arange(12)
        for _ in range(12):
            for a in range(12):
                for b in range(12):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        want[a] = want[b] = min(want[a], want[b])
        assert (group == want).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(7, 7)]
    reach = {x: {x} for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                reach[a] = reach[b] = reach[a] | reach[b]
    for x in reach:
        for y in reach[x]:
            reach[y] = reach[x] | reach[y]
    df = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(got(df, "node", "component")) == {x: min(r) for x, r in reach.items()}


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é日") for _ in range(n))
    shared = [text(rng.randint(150, 500)) for _ in range(4)]
    rows = [(200 + k, "".join(rng.choice([*shared, text(rng.randint(0, 300))]) for _ in range(5))) for k in range(14)]
    return rows + [(300, shared[0] + shared[0]), (301, "q" * 700), (302, "q" * 250)]


@pytest.mark.parametrize("hot", [False, True])
def test_passages(documents, hot, monkeypatch):
    rows = [(i, t) for i, t in AWKWARD if i != 10] + passages(5)
    if hot:  # every gram counted natively, crowded ones by window
        for name, value in (("HOT_SHARE", 1e-3), ("HOT_PHRASES", 1), ("BUCKET_PHRASES", 7), ("BUCKET_CONTEXTS", 3), ("CHUNK", 300)):
            monkeypatch.setattr(suffix_dedup, name, value)
    df = drop_repeated_bytes(documents(rows))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_spans(rows)


def test_kept_text_has_whole_characters(documents):
    same = "é" * 150
    rows = [(1, "日" + same + "本"), (2, same)]
    texts = dict(got(drop_repeated_bytes(documents(rows)), "doc_id", "kept_text"))
    assert texts == {1: "日本", 2: ""}


def test_empty_tables(documents):
    none = documents([])
    for df in (exact_duplicates(none), drop_repeated_lines(none), near_duplicates(none), drop_repeated_bytes(none)):
        assert df.count() == 0
    same = documents([(1, BASE), (1, BASE)])
    assert got(near_duplicates(same), "doc_id", "component_id") == [(1, 1), (1, 1)]


def test_spans_of_rows_without_ids(documents):
    """Texts of one id whose 32-bit checksums are equal keep spans of their own."""
    a, b = (" ".join(f"{c}{i * 7919 % 997}" for i in range(90)) for c in "ab")
    one, two = f"{a}plumless{b}", f"{a}buckeroo{b}"
    for rows in ([(None, one), (None, two), (7, one)], [(3, one), (3, two), (7, one)]):
        assert got(drop_repeated_bytes(documents(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_spans(rows)


def test_index_entries_are_short():
    """An entry takes at most 16 bytes, 20 for a set of more than 65,535 shingles; sets that share a head still meet."""
    import pandas as pd
    import pyarrow as pa

    from vitalgrid.llm import shingle_join as sj

    words = [f"w{i}" for i in range(70_000)]
    for texts, most in (([" ".join(words[:200]), " ".join(words[:199]), " ".join(words[300:400])], 16), ([" ".join(words), " ".join(words[:-1])], 20)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
        none = np.zeros(0, np.uint64)
        out = pd.concat([b.to_pandas() for b in sj.posted(iter([batch]), none, np.zeros(0, np.int64), 1)])
        n = sum(map(len, out["sets"])) // 8
        assert sum(len(v) for c in ("tokens", "sets", "sizes", "places") for v in out[c]) <= most * n
        found = sj.clustered((0,), out)
        owner, hashed = sj.shingle_sets([t.encode() for t in texts])
        assert set(found["d1"]) == set(sj.digests(owner, hashed, len(texts))[1][:2].tolist())
