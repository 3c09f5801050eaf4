"""Packing documents into fixed windows: best-fit decreasing over a segment tree.

A document longer than a window is first cut into full windows, each a sequence
of its own; what remains of every document is placed, longest first, into the
open window with the least room that still takes it. Open windows hang on the
leaves of a segment tree indexed by remaining capacity, so that window is found
in a climb and a descent.

Packing is local to a task: documents are taken in blocks of ``BLOCK``, packed
and emitted, so nothing is shuffled, no group depends on a key, memory does not
grow with the data, and a lost task is simply run again. Sequence ids join the
partition's number and a count within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of
from vitalgrid.llm.registry import query
from vitalgrid.llm.tokens import chunk_encoder, tokenizer_json

WINDOW = 1024
BLOCK = 8192
BLOCK_BYTES = 96 << 20
TEXTS = 256


class OpenWindows:
    """Open windows by remaining capacity; ``tree[node]`` counts those below a node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.stacks[capacity].append(window_id)
        self._count(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """Least capacity of at least ``need`` that has an open window."""
        node = self.leaves + need
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        self._count(capacity, -1)
        return self.stacks[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 to ``window`` long), and the number of windows."""
    at, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    free = OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity = free.tightest(need)
        if capacity is None:
            capacity, found = window, opened
            opened += 1
        else:
            found = free.take(capacity)
        at[i], offset[i] = found, window - capacity
        if capacity > need:
            free.put(capacity - need, found)
    return at, offset, opened


def cut_block(ids: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Pieces of a block's documents: row, start, length, window number and offset; and the number of windows."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    full, rest = sizes // window, sizes % window
    row = np.repeat(np.arange(len(ids)), full)
    number = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    left = np.flatnonzero(rest)
    where, offset, opened = best_fit(rest[left], window)
    return (
        np.concatenate([row, left]),
        np.concatenate([number * window, full[left] * window]),
        np.concatenate([np.full(len(row), window), rest[left]]),
        np.concatenate([opened + np.arange(len(row)), where]),
        np.concatenate([np.zeros(len(row), np.int64), offset]),
        opened + len(row),
    )


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, spec: str, window: int = WINDOW, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``spec`` is a tokenizer in JSON form; a document's ids are its text's and
    ``end_id``. ``ids`` holds the piece's ids as little-endian unsigned 32-bit
    integers. A null or empty text is ``end_id`` alone. Rows with equal or null
    doc_ids are packed as rows of their own. Other columns are not read; an
    empty table gives no rows. Results depend on how the table is cut into
    partitions, not on how often a task runs.
    """
    end = int(end_id).to_bytes(4, "little")
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def pieces(doc_ids: list, ids: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        row, start, length, where, offset, opened = cut_block(ids, window)
        cut = [ids[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        total = np.array([len(x) // 4 for x in ids], np.int64)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, pa.int64()).take(pa.array(row)), pa.array(start), pa.array(length),
                pa.array(cut, pa.binary()), pa.array(total[row]), pa.array(base + where), pa.array(offset),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        return batch, base + opened

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(sent.value)
        base = TaskContext.get().partitionId() << 40
        doc_ids: list = []
        ids: list[bytes] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                got = [x + end for x in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                doc_ids += some.column(0).to_pylist()
                ids += got
                held += sum(map(len, got))
                if len(ids) >= block or held >= BLOCK_BYTES:
                    out, base = pieces(doc_ids, ids, base)
                    for i in range(0, out.num_rows, 4096):
                        yield out.slice(i, 4096)
                    doc_ids, ids, held = [], [], 0
        if ids:
            out, base = pieces(doc_ids, ids, base)
            for i in range(0, out.num_rows, 4096):
                yield out.slice(i, 4096)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, PIECES)


def public_vocabulary(name: str) -> str:
    """A vocabulary file of the public_tokenizers package, as text."""
    import public_tokenizers

    return tokenizer_json(public_tokenizers.path(name))


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 byte-level ids."""
    out = pack_documents(documents_of(spark, folder), public_vocabulary("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
