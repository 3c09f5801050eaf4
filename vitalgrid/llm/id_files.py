"""Token-id files: an adaptive context-mixing range coder over independent blocks.

Ids are cut into blocks of ``BLOCK``. Each block starts with an empty model and
ends with a checksum, so it can be read alone. A block's model mixes three
predictions of the next id: the id that last followed the two ids before it
(order 2), the one that last followed the id before it (order 1), and the ids of
the block so far by their counts (order 0, renewed at doubling positions), with
a floor for ids not seen yet. Each share of the probability follows how often
that prediction was right lately. All of it is integer arithmetic.

numpy codes many blocks in step: one vector operation advances every block of a
segment by one id. A segment is one row of the table of files: the ids of a run
of whole documents, their lengths, and the coded blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of, shuffle_partitions
from vitalgrid.llm.packing import public_vocabulary
from vitalgrid.llm.registry import query
from vitalgrid.llm.tokens import chunk_encoder
from vitalgrid.session import checkpoint_dir

MAGIC = b"VGID\x01"
BLOCK = 4096
SEGMENT_IDS = 6 << 20
TEXTS = 256
FIRST_HISTORY = 64
NONE = 0xFFFF  # no prediction; ids are below it
SLOTS_BITS = 9
TOTAL_BITS = 24
TOP, BOTTOM, LOWER = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
RATE, LOW_SHARE, HIGH_SHARE = 5, 64, 60_000


class Model:
    """State of all blocks of a segment; one row per block."""

    def __init__(self, blocks: int):
        self.base = np.arange(blocks, dtype=np.uint32) << np.uint32(SLOTS_BITS)
        self.table1 = np.full(blocks << SLOTS_BITS, NONE, np.uint16)
        self.table2 = np.full(blocks << SLOTS_BITS, NONE, np.uint16)
        self.last1, self.last2 = np.zeros(blocks, np.uint32), np.zeros(blocks, np.uint32)
        self.share2, self.share1 = np.full(blocks, 4096, np.int32), np.full(blocks, 4096, np.int32)
        self.unseen = np.full(blocks, 32768, np.int32)

    def predict(self, log_history: int) -> None:
        """Predictions, and how the probability range is dealt out; -1 for an empty history."""
        shift, h1 = np.uint32(32 - SLOTS_BITS), self.last1 * np.uint32(0x9E3779B1)
        self.at1 = (h1 >> shift) + self.base
        self.at2 = ((h1 + self.last2 * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> shift) + self.base
        self.y1, self.y2 = self.table1[self.at1], self.table2[self.at2]
        self.has2 = self.y2 != NONE
        self.has1 = (self.y1 != NONE) & (self.y1 != self.y2)
        self.m2 = (self.share2 << (TOTAL_BITS - 16)) * self.has2
        left = (1 << TOTAL_BITS) - self.m2
        self.m1 = ((left >> 10) * self.share1 >> 6) * self.has1
        self.m12 = self.m2 + self.m1
        rest = left - self.m1
        if log_history < 0:
            self.floor, self.each = rest >> 16, rest
        else:
            self.floor = np.maximum((rest >> 10) * self.unseen >> 22, 1)
            self.each = (rest - (self.floor << 16)) >> log_history
        self.seen_from = self.m12 + (self.floor << 16)

    def learn(self, ids: np.ndarray, is2: np.ndarray, is1: np.ndarray, new: np.ndarray) -> None:
        """Shares move towards a bound of their own, so they never leave the two bounds."""
        gap = np.int32(HIGH_SHARE - LOW_SHARE)
        self.share2 += ((is2 * gap + np.int32(LOW_SHARE) - self.share2) >> RATE) * self.has2
        self.share1 += ((is1 * gap + np.int32(LOW_SHARE) - self.share1) >> RATE) * (self.has1 & ~is2)
        self.unseen += ((new * gap + np.int32(LOW_SHARE) - self.unseen) >> RATE) * ~(is1 | is2)
        self.table1[self.at1] = ids
        self.table2[self.at2] = ids
        self.last2, self.last1 = self.last1, ids.view(np.uint32)


class History:
    """Sorted ids of each block so far: where an id's run starts and how long it is."""

    def __init__(self, ids: np.ndarray):
        blocks, n = ids.shape
        self.n = n
        self.sorted = np.sort(ids, axis=1)
        self.fresh = np.ones((blocks, n), bool)
        self.fresh[:, 1:] = self.sorted[:, 1:] != self.sorted[:, :-1]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the run at every sorted position."""
        blocks, n = self.sorted.shape
        at = np.arange(n, dtype=np.int32)
        first = np.maximum.accumulate(np.where(self.fresh, at, 0), axis=1)
        ends = np.full((blocks, n), n, np.int32)
        ends[:, :-1] = np.where(self.fresh[:, 1:], at[1:], n)
        return first, np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - first

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count of every id of (blocks, m), as (m, blocks); count 0 where it is new."""
        blocks, m = ids.shape
        starts, counts = np.empty((blocks, m), np.int32), np.empty((blocks, m), np.int32)
        start_of, count_of = np.zeros(NONE + 1, np.int32), np.zeros(NONE + 1, np.int32)
        for i in range(blocks):
            heads = np.flatnonzero(self.fresh[i])
            known = self.sorted[i, heads]
            start_of[known] = heads
            count_of[known] = np.diff(heads, append=self.n)
            starts[i], counts[i] = start_of[ids[i]], count_of[ids[i]]
            count_of[known] = 0
        return np.ascontiguousarray(starts.T), np.ascontiguousarray(counts.T)


def history_ends(n: int) -> list[int]:
    """Positions at which order 0 is renewed: 0, then doubling."""
    out, at = [0], FIRST_HISTORY
    while at < n:
        out.append(at)
        at *= 2
    return out


def code_blocks(ids: np.ndarray) -> list[bytes]:
    """Coded words of full blocks, (blocks, n) ids."""
    blocks, n = ids.shape
    model = Model(blocks)
    low, span = np.zeros(blocks, np.uint64), np.full(blocks, 2**64 - 1, np.uint64)
    room = 2 * n + 8
    out, used = np.zeros(blocks * room, np.uint16), np.arange(blocks) * room
    columns = np.ascontiguousarray(ids.T.astype(np.int32))
    ends = history_ends(n)
    for begin, stop in zip(ends, [*ends[1:], n], strict=True):
        past = History(ids[:, :begin]).find(ids[:, begin:stop]) if begin else None
        for t in range(begin, stop):
            x = columns[t]
            model.predict(begin.bit_length() - 1)
            is2 = x == model.y2
            is1 = (x == model.y1) & ~is2
            if past:
                s0, c0 = past[0][t - begin], past[1][t - begin]
                known = c0 > 0
                start = np.where(known, model.seen_from + s0 * model.each, model.m12 + x * model.floor)
                width = np.where(known, c0 * model.each, model.floor)
                new = ~known
            else:
                start, width, new = model.m12 + x * model.floor, model.floor.copy(), np.ones(blocks, bool)
            at = np.flatnonzero(is1)
            start[at], width[at] = model.m2[at], model.m1[at]
            at = np.flatnonzero(is2)
            start[at], width[at] = 0, model.m2[at]
            unit = span >> np.uint64(TOTAL_BITS)
            low += unit * start.astype(np.uint64)
            span = unit * width.astype(np.uint64)
            go = np.flatnonzero(((low ^ (low + span)) < TOP) | (span < BOTTOM))
            while len(go):
                l, s = low[go], span[go]
                s = np.where((l ^ (l + s)) < TOP, s, (~l + np.uint64(1)) & LOWER)
                out[used[go]] = l >> np.uint64(48)
                used[go] += 1
                l, s = l << np.uint64(16), s << np.uint64(16)
                low[go], span[go] = l, s
                go = go[((l ^ (l + s)) < TOP) | (s < BOTTOM)]
            model.learn(x, is2, is1, new)
    for _ in range(4):
        out[used] = low >> np.uint64(48)
        used += 1
        low <<= np.uint64(16)
    return [out[i * room : used[i]].tobytes() for i in range(blocks)]


def decode_blocks(coded: list[bytes], n: int) -> np.ndarray:
    """(blocks, n) ids back from their words."""
    blocks = len(coded)
    room = max(len(c) for c in coded) // 2 + 8
    words = np.zeros(blocks * room, np.uint16)
    for i, c in enumerate(coded):
        words[i * room : i * room + len(c) // 2] = np.frombuffer(c, "<u2")
    model = Model(blocks)
    low, span = np.zeros(blocks, np.uint64), np.full(blocks, 2**64 - 1, np.uint64)
    code, used = np.zeros(blocks, np.uint64), np.arange(blocks) * room
    for _ in range(4):
        code = (code << np.uint64(16)) | words[used]
        used += 1
    ids = np.zeros((n, blocks), np.int32)
    ends = history_ends(n)
    for begin, stop in zip(ends, [*ends[1:], n], strict=True):
        if begin:
            past = History(np.ascontiguousarray(ids[:begin].T))
            flat_ids = past.sorted.ravel()
            flat_first, flat_count = (x.ravel() for x in past.runs())
            rows = np.arange(blocks, dtype=np.int32) * begin
        for t in range(begin, stop):
            model.predict(begin.bit_length() - 1)
            unit = span >> np.uint64(TOTAL_BITS)
            value = np.minimum((code - low) // unit, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int32)
            is2 = value < model.m2
            is1 = (value < model.m12) & ~is2
            # Quotients of integers below 2**24 are exact to the floor in double precision.
            x = ((value - model.m12) / model.floor).astype(np.int32)
            start, width = model.m12 + x * model.floor, model.floor.copy()
            if begin:
                known = value >= model.seen_from
                slot = ((value - model.seen_from) / model.each).astype(np.int32)
                at = rows + np.clip(slot, 0, begin - 1)
                x = np.where(known, flat_ids[at], x)
                start = np.where(known, model.seen_from + flat_first[at] * model.each, start)
                width = np.where(known, flat_count[at] * model.each, width)
                new = ~known
            else:
                new = np.ones(blocks, bool)
            at = np.flatnonzero(is1)
            x[at], start[at], width[at] = model.y1[at], model.m2[at], model.m1[at]
            at = np.flatnonzero(is2)
            x[at], start[at], width[at] = model.y2[at], 0, model.m2[at]
            low += unit * start.astype(np.uint64)
            span = unit * width.astype(np.uint64)
            go = np.flatnonzero(((low ^ (low + span)) < TOP) | (span < BOTTOM))
            while len(go):
                l, s = low[go], span[go]
                s = np.where((l ^ (l + s)) < TOP, s, (~l + np.uint64(1)) & LOWER)
                code[go] = (code[go] << np.uint64(16)) | words[used[go]]
                used[go] += 1
                l, s = l << np.uint64(16), s << np.uint64(16)
                low[go], span[go] = l, s
                go = go[((l ^ (l + s)) < TOP) | (s < BOTTOM)]
            ids[t] = x
            model.learn(x, is2, is1, new)
    return np.ascontiguousarray(ids.T)


def pack_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """All ids (below 65535) as blocks of a segment: header, block table (bytes, crc32), coded words."""
    n = -(-len(ids) // block)
    padded = np.zeros(n * block, np.int32)
    padded[: len(ids)] = ids
    padded = padded.reshape(n, block)
    coded = code_blocks(padded) if n else []
    table = b"".join(
        struct.pack("<II", len(c), zlib.crc32(padded[i].astype("<u4").tobytes())) for i, c in enumerate(coded)
    )
    return b"".join([MAGIC, struct.pack("<IIQ", block, n, len(ids)), table, *coded])


def unpack_ids(data: bytes) -> np.ndarray:
    """ids of a segment; a block that fails its checksum raises."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id segment")
    block, n, total = struct.unpack_from("<IIQ", data, len(MAGIC))
    at = len(MAGIC) + 16
    table = np.frombuffer(data, "<u4", 2 * n, at).reshape(n, 2)
    at += 8 * n
    ends = at + np.cumsum(table[:, 0], dtype=np.int64)
    coded = [data[e - size : e] for e, size in zip(ends.tolist(), table[:, 0].tolist(), strict=True)]
    if not n:
        return np.zeros(0, np.int32)
    ids = decode_blocks(coded, block)
    for i in range(n):
        if zlib.crc32(ids[i].astype("<u4").tobytes()) != table[i, 1]:
            raise ValueError(f"block {i} fails its checksum")
    return ids.ravel()[:total]


FILES = "part int, at int, ids_before long, doc_ids array<long>, lengths array<int>, segment binary"


def write_id_files(docs: DataFrame, path: str, spec: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, add ``end_id``, and write segments in ascending doc_id order.

    Part files follow the order of ids; ``part`` and ``at`` give a segment's
    place, ``ids_before`` the ids of the part before it. A null or empty text is
    ``end_id`` alone. Rows with equal ids follow one another in the order of a
    text hash, null ids come first. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    end = int(end_id).to_bytes(4, "little")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at, before = chunk_encoder(sent.value), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        ids: list[bytes] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            data = pack_ids(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([data], pa.binary()),
                ],
                names=["part", "at", "ids_before", "doc_ids", "lengths", "segment"],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                some = batch.slice(first, TEXTS)
                got = [x + end for x in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                doc_ids += some.column(0).to_pylist()
                ids += got
                held += sum(len(x) // 4 for x in got)
                if held >= segment_ids:
                    yield flushed()
                    at, before, doc_ids, ids, held = at + 1, before + held, [], [], 0
        if ids:
            yield flushed()

    tie = F.xxhash64("text")
    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(segments, FILES)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian)."""
    files = spark.read.schema(FILES).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids = unpack_ids(row.column(5)[0].as_py()).astype("<u4")
                lengths = row.column(4).flatten().to_numpy().astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                for a in range(0, len(lengths), TEXTS):
                    b = min(a + TEXTS, len(lengths))
                    own = [ids[s : s + n].tobytes() for s, n in zip(starts[a:b].tolist(), lengths[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(b - a, row.column(0)[0].as_py(), np.int32)),
                            row.column(3).flatten().slice(a, b - a),
                            pa.array(row.column(2)[0].as_py() + starts[a:b]),
                            pa.array(lengths[a:b]),
                            pa.array(own, pa.binary()),
                        ],
                        names=["part", "doc_id", "in_part", "n_tokens", "ids"],
                    )

    rows = files.mapInArrow(documents, "part int, doc_id long, in_part long, n_tokens long, ids binary")
    sizes = (
        files.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
        .groupBy("part")
        .agg(F.sum("n").alias("n"))
    )
    # One row per part file; their number is the number of shuffle partitions at writing.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids"
    )


@query("op10_id_files")
def op10_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written to id files in the shared folder, and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_id_files(documents_of(spark, folder), path, public_vocabulary("word_bpe_49k.json"))
    return read_id_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
