"""Line deduplication through sharded minimal perfect hashes.

Lines that occur in two or more documents are reduced to 128-bit hashes and cut
into shards of about ``shard_keys``. A shard becomes a minimal perfect hash (a
cascade of bit arrays: a key lands on the first level where it is alone at its
position, its slot is the rank of that bit) over three plain arrays: a 64-bit
fingerprint, the smallest document holding the line, and the number of rows
holding it. Documents send their line hashes to the arrays; lines themselves
never move. A shard that receives many probes (one line in a third of all
documents) is copied to several tasks, and the probes are dealt over the copies.
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

from vitalgrid.llm.common import documents_of, parts_for
from vitalgrid.llm.registry import query
from vitalgrid.session import cut_lineage

SPACE = " \t\n\v\f\r"
MIN_CHARS = 10
SHARD_KEYS = 50_000
PROBES = 200_000
MAX_LEVELS = 24
NO_ID = -(2**63)


def keyed_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Line offsets per text, the lines, their keys, and which keys are long enough."""
    split = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    lines = split.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))
    long_enough = pc.greater_equal(pc.utf8_length(keys), MIN_CHARS).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    return offsets, lines, keys, long_enough


def hashed_keys(keys: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each wanted key's hash, zeros elsewhere."""
    high, low = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at = np.flatnonzero(wanted)
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.take(pa.array(at)).to_pylist())
    pair = np.frombuffer(digests, dtype=">i8").reshape(-1, 2)
    high[at], low[at] = pair[:, 0], pair[:, 1]
    return high, low


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (doc, high, low): one row per row and distinct key."""
    for batch in batches:
        offsets, _, keys, wanted = keyed_lines(batch.column(1))
        high, low = hashed_keys(keys, wanted)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[wanted]
        each = np.unique(np.rec.fromarrays([row, high[wanted], low[wanted]], names="row,high,low"))
        docs = batch.column(0).to_numpy()[each.row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs), pa.array(np.ascontiguousarray(each.high)), pa.array(np.ascontiguousarray(each.low))],
            names=["doc", "high", "low"],
        )


def mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    x = high.astype(np.uint64) + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= np.uint64((level + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys, stored as bit arrays; slots are 0..n-1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
            base += int(bits.sum())
        self.base = base

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        left, levels = np.arange(len(high)), []
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = max(64, 2 * len(left))
            at = (mixed(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        rest = np.sort(np.rec.fromarrays([high[left], low[left]], names="high,low"))  # keys no level could part
        return cls(levels, rest)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key; for keys that were not built in, any slot or -1."""
        out, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, bits in enumerate(self.levels):
            at = (mixed(high[left], low[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            probe = np.rec.fromarrays([high[left], low[left]], names="high,low")
            at = np.minimum(np.searchsorted(self.rest, probe), len(self.rest) - 1)
            found = self.rest[at] == probe
            out[left[found]] = self.base + at[found]
        return out

    def packed(self) -> tuple[list[int], bytes, bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels), self.rest.tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], bits: bytes, rest: bytes) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            n = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(levels, np.frombuffer(rest, dtype=[("high", "<i8"), ("low", "<i8")]).view(np.recarray))


SHARD = "shard long, sizes array<long>, bits binary, rest binary, prints binary, holders binary, counts binary"


def build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    high, low = rows["high"].to_numpy(), rows["low"].to_numpy()
    index = PerfectHash.build(high, low)
    slots = index.slots(high, low)
    prints, holders, counts = np.empty_like(low), np.empty_like(low), np.empty_like(low)
    prints[slots], holders[slots], counts[slots] = high ^ low, rows["holder"].to_numpy(), rows["n"].to_numpy()
    sizes, bits, rest = index.packed()
    return pd.DataFrame(
        {
            "shard": [key[0]], "sizes": [sizes], "bits": [bits], "rest": [rest],
            "prints": [prints.tobytes()], "holders": [holders.tobytes()], "counts": [counts.tobytes()],
        }
    )


def probe_shard(key: tuple, probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """Keys that the document of a probe must give up."""
    if not len(probes) or not len(shard):
        return pd.DataFrame({"doc": [], "high": [], "low": []}).astype("int64")
    s = shard.iloc[0]
    index = PerfectHash.unpacked(list(s["sizes"]), s["bits"], s["rest"])
    prints, holders = np.frombuffer(s["prints"], np.int64), np.frombuffer(s["holders"], np.int64)
    high, low = probes["high"].to_numpy(), probes["low"].to_numpy()
    slots = index.slots(high, low)
    known = slots >= 0
    known[known] = prints[slots[known]] == (high ^ low)[known]
    known[known] = holders[slots[known]] != probes["doc"].to_numpy()[known]
    return probes.loc[known, ["doc", "high", "low"]]


def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, drops) -> counts and the text without the dropped keys' lines."""
    for batch in batches:
        offsets, lines, keys, wanted = keyed_lines(batch.column(1))
        drops = batch.column(2).to_pylist()
        needed = np.repeat(np.array([d is not None for d in drops], bool), np.diff(offsets)) & wanted
        high, low = hashed_keys(keys, needed)
        n_lines, n_dropped, kept = [], [], []
        texts = pc.fill_null(batch.column(1), "").to_pylist()
        for i, drop in enumerate(drops):
            first, last = int(offsets[i]), int(offsets[i + 1])
            n_lines.append(last - first)
            if drop is None:
                n_dropped.append(0)
                kept.append(texts[i])
                continue
            gone = {(d["high"], d["low"]) for d in drop}
            stay = [
                not (needed[j] and (high[j], low[j]) in gone) for j in range(first, last)
            ]
            n_dropped.append(last - first - sum(stay))
            kept.append("\n".join(x for x, s in zip(lines[first:last].to_pylist(), stay, strict=True) if s))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                pa.array(kept, pa.string()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
                *[batch.column(i) for i in range(3, batch.num_columns)],
            ],
            names=["doc", "n_lines", "n_dropped", "kept_text", "kept_sha256", *batch.schema.names[3:]],
        )


def repeated_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, holder, last, n) -> keys of two or more documents, and one row without a key: the sum of all n."""
    total, names = 0, ["high", "low", "holder", "n"]
    for batch in batches:
        total += pc.sum(batch.column(4)).as_py() or 0
        again = pc.not_equal(batch.column(2), batch.column(3))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(again) for i in (0, 1, 2, 4)], names=names)
    none = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.array([total])], names=names)


def repeated_lines(rows: DataFrame) -> tuple[DataFrame, int]:
    """Table of the keys held by two or more documents (high, low, holder, n), and the number of probes in all."""
    counted = rows.groupBy("high", "low").agg(
        F.min("doc").alias("holder"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")
    )
    table = cut_lineage(counted.mapInArrow(repeated_only, "high long, low long, holder long, n long"))
    probes = table.filter("high IS NULL").agg(F.sum("n")).first()[0]
    return table.filter("high IS NOT NULL"), probes or 0


def drop_repeated_lines(docs: DataFrame, carry: list[str] = (), shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """Per input row: doc_id, n_lines, n_dropped, kept_text, kept_sha256, and the ``carry`` columns.

    A text is split at line feeds (null or empty: one empty line). Keys are
    lines stripped of ASCII white space with A-Z lower-cased; a key of ten or
    more code points that two documents hold stays in the smallest doc_id only.
    Repeats inside the holder stay. Rows that share a doc_id are one document
    here; a null doc_id is one document before all others. An empty table gives
    no rows; columns that are not carried are not read.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", *[F.col(c).alias(f"with_{c}") for c in carry])
    rows = base.select("doc", "text").mapInArrow(line_hashes, "doc long, high long, low long")
    repeated, n_probes = repeated_lines(rows)
    n_shards = parts_for(repeated.count(), shard_keys)
    shard_of = F.pmod(F.col("high"), F.lit(n_shards))
    by_shard = repeated.withColumn("shard", shard_of)
    copies = (
        by_shard.groupBy("shard")
        .agg(F.sum("n").alias("hits"))
        .select("shard", F.ceil((F.col("hits") + n_probes // n_shards) / probes).cast("int").alias("copies"))
    )
    index = by_shard.groupBy("shard").applyInPandas(build_shard, SHARD).join(copies, "shard")
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = (
        rows.withColumn("shard", shard_of)
        .join(copies, "shard")
        .withColumn("copy", F.pmod(F.xxhash64("doc", "high"), F.col("copies")).cast("int"))
        .drop("copies")
    )
    drops = (
        dealt.groupBy("shard", "copy")
        .cogroup(index.groupBy("shard", "copy"))
        .applyInPandas(probe_shard, "doc long, high long, low long")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("high", "low")).alias("drops"))
    )
    kinds = dict(docs.dtypes)
    extra = "".join(f", `with_{c}` {kinds[c]}" for c in carry)
    out = (
        base.join(drops, "doc", "left")
        .select("doc", "text", "drops", *[f"with_{c}" for c in carry])
        .mapInArrow(
            drop_lines, f"doc long, n_lines long, n_dropped long, kept_text string, kept_sha256 string{extra}"
        )
    )
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_dropped", "kept_text", "kept_sha256",
        *[F.col(f"with_{c}").alias(c) for c in carry],
    )


ORACLE = """
WITH l AS (SELECT doc_id, pos, line, lower_key FROM (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))),
r AS (SELECT lower_key, min(doc_id) AS holder FROM l WHERE length(lower_key) >= 10
      GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, r.holder IS NOT NULL AND r.holder <> l.doc_id AS gone FROM l LEFT JOIN r USING (lower_key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op2_line_dedup", ORACLE)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines an earlier document already has."""
    out = drop_repeated_lines(documents_of(spark, folder))
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")
