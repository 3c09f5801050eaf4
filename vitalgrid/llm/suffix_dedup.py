"""Repeated byte strings by prefix-free parsing.

Triggers. A rolling hash of every 32-byte gram is taken; each 200-byte window is
anchored at the gram of least hash inside it (the leftmost of equals). The
anchor depends on the window's bytes alone, so equal windows are anchored alike.

Parse. Neighbouring windows with one anchor form a phrase, the bytes from the
first window's start to the last one's end. A document is a sequence of phrases
that overlap by less than a window, so no phrase is a prefix of another place's
reading: a window lies inside exactly one phrase, at one distance from its anchor.

Combination. Where a phrase occurs twice in the parse, all its windows are
repeated, without a look at the text. Phrases that occur once but share their
gram with another phrase go to a dictionary; there the 200-byte suffix heads of
all phrases of a gram are ranked by prefix doubling, as in a suffix array, and
equal ranks are repeated windows. All comparisons of dictionary text are exact.

Hot keys. Grams that hold a large share of the parse are found with a bounded
counter table and counted by a pre-aggregated grouping instead of in one task;
a gram with very many phrases has its windows counted one by one by a 128-bit
hash, again pre-aggregated. Nothing is left out in either case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of, parts_for, rows_of_ids
from vitalgrid.llm.registry import query
from vitalgrid.llm.rolling import RollingHash, sliding_min
from vitalgrid.session import cut_lineage

LENGTH = 200
GRAM = 32
CHUNK = 2 << 20
HOT_SHARE = 1e-4
BUCKET_PHRASES = 150_000
BUCKET_CONTEXTS = 8_000
HOT_PHRASES = 4_000
COPIES = 64
NO_ID = -(2**63)
POSITION = np.uint64(0xFFFFFF)


def phrases_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Gram hash, phrase hash, first and last window start of each phrase of texts joined in ``data``."""
    nothing = np.zeros(0, np.uint64)
    if len(data) < length:
        return nothing, nothing, nothing.astype(np.int64), nothing.astype(np.int64)
    rolling = RollingHash(data)
    grams = rolling.windows(gram)
    ranked = (grams & ~POSITION) | (np.arange(len(grams), dtype=np.uint64) & POSITION)
    anchor = (sliding_min(ranked, length - gram + 1) & POSITION).astype(np.int64)
    own_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + length <= own_end)
    if not len(starts):
        return nothing, nothing, nothing.astype(np.int64), nothing.astype(np.int64)
    at = anchor[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    left, right, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first]
    phrase = rolling.spans(left, right + length) ^ ((at - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return grams[at], phrase, left, right


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, twin, text) -> one row per phrase. Texts are read in joined pieces of about ``CHUNK`` bytes."""
    for batch in batches:
        texts = pc.fill_null(batch.column(2), "").cast(pa.large_binary()).to_pylist()
        pieces: list[bytes] = []
        owner: list[int] = []
        shift: list[int] = []
        held = 0

        def rows() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in pieces])
            gram, phrase, left, right = phrases_of(np.frombuffer(b"".join(pieces), np.uint8), ends)
            piece = np.searchsorted(ends, left, side="right")
            row = np.array(owner)[piece]
            move = np.array(shift)[piece] - (ends - np.diff(ends, prepend=0))[piece]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                    pa.array(gram.view(np.int64)), pa.array(phrase.view(np.int64)),
                    pa.array((left + move).astype(np.int32)), pa.array((right + move).astype(np.int32)),
                ],
                names=["doc", "twin", "gram", "phrase", "l", "r"],
            )

        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
                pieces.append(text[at : at + CHUNK + LENGTH - 1])
                owner.append(i)
                shift.append(at)
                held += len(pieces[-1])
                if held >= CHUNK:
                    yield rows()
                    pieces, owner, shift, held = [], [], [], 0
        if held >= LENGTH:
            yield rows()


RUN = "doc long, twin long, gram long, l int, r int, kind int"
FULL, ONCE, SAMPLE = 0, 1, 2


def classify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Phrases of a bucket: FULL (without gram) where the phrase repeats; ONCE, and a SAMPLE of each repeated one, where grams are shared."""
    gram, phrase = rows["gram"].to_numpy(), rows["phrase"].to_numpy()
    order = np.lexsort((phrase, gram))
    gram, phrase = gram[order], phrase[order]
    new_gram, new_phrase = np.ones(len(gram), bool), np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new_phrase[1:] = new_gram[1:] | (phrase[1:] != phrase[:-1])
    group, word = np.cumsum(new_gram) - 1, np.cumsum(new_phrase) - 1
    times, mates = np.bincount(word)[word], np.bincount(group[new_phrase])[group]
    full, once = times > 1, (times == 1) & (mates > 1)
    sample = new_phrase & full & (mates > 1)
    out = rows.iloc[order].drop(columns=["phrase", "bucket"]).astype({"gram": "Int64"})
    return pd.concat(
        [out[full].assign(kind=FULL, gram=pd.NA), out[once].assign(kind=ONCE), out[sample].assign(kind=SAMPLE)]
    ).astype({"gram": "Int64"})[["doc", "twin", "gram", "l", "r", "kind"]]


def counted_natively(rows: DataFrame) -> DataFrame:
    """``classify`` for hot grams: counts are combined before the shuffle; repeated phrases meet their instances in ``COPIES`` places."""
    place = F.struct("doc", "twin", "l")
    counts = (
        rows.groupBy("gram", "phrase")
        .agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("sample"))
        .filter("times > 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    )
    known = rows.withColumn("copy", F.pmod(F.xxhash64("doc", "l"), F.lit(COPIES)).cast("int")).join(
        counts, ["gram", "phrase", "copy"], "left"
    )
    kinds = F.array_compact(
        F.array(F.when(F.col("times").isNull(), ONCE).otherwise(FULL), F.when(place == F.col("sample"), SAMPLE))
    )
    kept = known.select("doc", "twin", "gram", "l", "r", F.explode(kinds).alias("kind"))
    return kept.withColumn("gram", F.when(F.col("kind") != FULL, F.col("gram")))


CONTEXT = "doc long, twin long, gram long, l int, kind int, context binary, w1 long, w2 long"


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, twin, text, needs) -> the phrases' bytes; for hot grams one row per window with its hash instead."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            doc, twin, text = row.column(0)[0].as_py(), row.column(1)[0].as_py(), (row.column(2)[0].as_py() or "").encode()
            out: dict[str, list] = {k: [] for k in ("gram", "l", "kind", "context", "w1", "w2")}
            for need in row.column(3)[0].as_py():
                if not need["hot"]:
                    places = [(need["l"], text[need["l"] : need["r"] + LENGTH], None, None)]
                else:
                    places = []
                    for at in range(need["l"], need["r"] + 1):
                        digest = xxhash.xxh3_128_digest(text[at : at + LENGTH])
                        places.append((at, None, *(int.from_bytes(d, "big", signed=True) for d in (digest[:8], digest[8:]))))
                for at, context, w1, w2 in places:
                    for name, value in zip(out, (need["gram"], at, need["kind"], context, w1, w2), strict=True):
                        out[name].append(value)
            n = len(out["l"])
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc] * n, pa.int64()), pa.array([twin] * n, pa.int64()),
                    *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)],
                ],
                names=["doc", "twin", *out],
            )


def head_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of the ``length``-byte heads of the suffixes at ``starts``, by prefix doubling.

    Positions alone in their rank at some depth cannot be equal to another any
    more; they are ranked no further, and neither is what depends on them.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(len(data), np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | padded[k : k + len(data)]
    rank, depth = _dense(keys, np.arange(len(data)), len(data)), 8
    while depth < length:
        step = min(depth, length - depth)
        here = np.flatnonzero(rank[: len(rank) - step] >= 0) if len(rank) > step else np.zeros(0, np.int64)
        there = rank[here + step]
        here, there = here[there >= 0], there[there >= 0]
        both = rank[here].astype(np.uint64) * np.uint64(len(data) + 1) + there.astype(np.uint64)
        rank, depth = _dense(both, here, len(data)), depth + step
    return rank[starts]


def _dense(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Order of the keys found more than once, -1 elsewhere."""
    out = np.full(n, -1, np.int64)
    if len(keys):
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        out[at] = np.where(count[inverse] > 1, inverse, -1)
    return out


FOUND = "doc long, twin long, l int, r int"


def repeated_in_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated windows of the phrases that occur once."""
    sizes = rows["context"].str.len().to_numpy()
    data = np.frombuffer(b"".join(rows["context"]), np.uint8)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[owner] + offset
    rank = head_ranks(data, starts)
    # Only starts of windows are counted: other places of the joined text may run over a border.
    seen = np.bincount(rank[rank >= 0], minlength=1)
    hit = (rank >= 0) & (seen[np.maximum(rank, 0)] > 1) & (rows["kind"].to_numpy()[owner] == ONCE)
    owner, offset = owner[hit], offset[hit]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    own = owner[first]
    left = rows["l"].to_numpy()[own]
    return pd.DataFrame(
        {
            "doc": rows["doc"].to_numpy()[own], "twin": rows["twin"].to_numpy()[own],
            "l": (left + offset[first]).astype(np.int32), "r": (left + offset[last]).astype(np.int32),
        }
    )


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs, ...) -> counts and the bytes outside the runs."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary()).to_pylist()
        n_bytes, n_removed, n_spans, kept, kept_text = [], [], [], [], []
        for text, runs in zip(texts, batch.column(2).to_pylist(), strict=True):
            parts, at, spans = [], 0, 0
            for run in sorted((x["l"], x["r"] + LENGTH) for x in runs or []):
                if run[0] > at or not spans:
                    parts.append(text[at : run[0]])
                    spans += 1
                at = max(at, run[1])
            parts.append(text[at:])
            kept.append(b"".join(parts))
            kept_text.append("".join(p.decode("utf-8", "ignore") for p in parts))
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept[-1]))
            n_spans.append(spans)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                pa.array(kept, pa.binary()), pa.array(kept_text, pa.string()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                *batch.columns[3:],
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256", *batch.schema.names[3:]],
        )


def repeated_runs(base: DataFrame) -> DataFrame:
    """(doc, twin, l, r): window starts l..r of that row's text occur elsewhere too. ``base`` has doc, twin, text."""
    parsed = cut_lineage(base.mapInArrow(parse, "doc long, twin long, gram long, phrase long, l int, r int"))
    # A counter table of 1 / HOT_SHARE entries per task: every gram with a larger share is in it.
    hot = [g for g in parsed.stat.freqItems(["gram"], HOT_SHARE).first()[0] or [] if g is not None]
    is_hot = F.col("gram").isin(hot) if hot else F.lit(False)
    buckets = parts_for(parsed.count(), BUCKET_PHRASES)
    marked = cut_lineage(
        parsed.filter(~is_hot)
        .withColumn("bucket", F.pmod("gram", F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(classify, RUN)
        .unionByName(counted_natively(parsed.filter(is_hot)))
    )
    open_phrases = marked.filter(F.col("kind") != FULL)
    crowded = (
        open_phrases.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PHRASES)
        .select("gram", F.lit(True).alias("hot"))
    )
    needs = (
        open_phrases.join(crowded, "gram", "left")
        .groupBy("doc", "twin")
        .agg(F.collect_list(F.struct("gram", "l", "r", "kind", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("needs"))
    )
    dictionary = cut_lineage(
        rows_of_ids(base, open_phrases, "doc").join(needs, ["doc", "twin"]).select("doc", "twin", "text", "needs").mapInArrow(contexts, CONTEXT)
    )
    plain, single = dictionary.filter("context IS NOT NULL"), dictionary.filter("context IS NULL")
    buckets = parts_for(plain.count(), BUCKET_CONTEXTS)
    by_rank = (
        plain.withColumn("bucket", F.pmod("gram", F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(repeated_in_bucket, FOUND)
    )
    windows = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    by_hash = single.filter(F.col("kind") == ONCE).join(windows, ["w1", "w2"]).select("doc", "twin", "l", F.col("l").alias("r"))
    return marked.filter(F.col("kind") == FULL).select("doc", "twin", "l", "r").unionByName(by_rank).unionByName(by_hash)


def drop_repeated_bytes(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_text, kept_sha256, and the ``carry`` columns.

    Texts are UTF-8 bytes; a null text is empty. A run may begin or end inside a
    character: ``kept`` has the remaining bytes, ``kept_text`` the whole characters among them. Every byte covered by a 200-byte
    string that also starts elsewhere, in any row or the same one, goes, so the
    first copy goes as well. Rows that repeat an id keep spans of their own. An
    empty table gives no rows; columns that are not carried are not read.
    """
    base = docs.select(
        # Rows of one id are told apart by a hash of the text; rows without an id by two.
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(NO_ID), "text")).alias("doc"),
        F.xxhash64("text").alias("twin"),
        "text",
        F.col("doc_id").cast("long").alias("own_id"),
        *[F.col(c).alias(f"with_{c}") for c in carry],
    )
    runs = repeated_runs(base.select("doc", "twin", "text")).groupBy("doc", "twin").agg(
        F.collect_list(F.struct("l", "r")).alias("runs")
    )
    kinds = dict(docs.dtypes)
    extra = "".join(f", `with_{c}` {kinds[c]}" for c in carry)
    out = (
        base.join(runs, ["doc", "twin"], "left")
        .select("own_id", "text", "runs", *[f"with_{c}" for c in carry])
        .mapInArrow(
            cut,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string" + extra,
        )
    )
    return out.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256",
        *[F.col(f"with_{c}").alias(c) for c in carry],
    )


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without bytes of repeated 200-byte strings."""
    out = drop_repeated_bytes(documents_of(spark, folder))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
