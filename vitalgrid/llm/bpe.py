"""BPE as a bounded-lookahead transducer, and its decoder.

``sufficient_lookahead`` reads off the merge list how far to the right of a
token the text can still change it. A token ends in one of its right operands;
a merge of higher priority may take that operand away together with what stands
behind it, that merge may lose its own right operand in the same way, and so on
with ever higher priorities; on the left, a merge may take the token's left
operand, with a dependence on the right of its own. One pass over the merges in
order of priority adds these distances up. The transducer emits a token as soon
as that many symbols have been read behind it, so its memory does not depend on
the length of the text; text is cut at white space first, where no merge ever
reaches across.

The decoder turns ids into bytes and bytes into text with a state machine that
carries an unfinished character over to the next ids.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import documents_of
from vitalgrid.llm.packing import public_vocabulary
from vitalgrid.llm.registry import query
from vitalgrid.llm.tokens import word_chunks

MAX_CHUNKS = 500_000
LONGEST_KEPT = 64
TEXTS = 256
IDS_AT_ONCE = 8192
#: Code points with the White_Space property: what ``\s`` means to the vocabulary's patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], width: dict[int, int]) -> int:
    """Symbols behind a position that settle whether a token ends there.

    ``merges`` are (left, right, result) in order of priority, ``width`` the
    symbols in each token. ``reach[x]`` is how far behind its own end the making
    of x can depend on the text.
    """
    reach: dict[int, int] = {}
    from_right: dict[int, int] = {}  # x -> farthest a merge (x, w) so far depends on, from the end of x
    from_left: dict[int, int] = {}  # x -> the same of a merge (y, x)
    need = 0
    for left, right, made in merges:
        own = max(
            0,
            reach.get(right, 0),
            reach.get(left, 0) - width[right],
            from_right.get(right, 0),
            from_left.get(left, 0) - width[right],
        )
        reach[made] = max(own, reach.get(made, 0))
        from_right[left] = max(from_right.get(left, 0), width[right] + own)
        from_left[right] = max(from_left.get(right, 0), own)
        need = max(need, width[made] - 1 + own)
    return need


class Merger:
    """Merges of one vocabulary over lists of symbol ids."""

    def __init__(self, merges: list[tuple[int, int, int]], width: dict[int, int]):
        self.rule = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(merges)}
        self.width = width
        self.lookahead = sufficient_lookahead(merges, width)
        self.buffer = 4 * self.lookahead + 64

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges, lowest rank first, leftmost first."""
        return self._small(symbols) if len(symbols) <= 48 else self._large(symbols)

    def _small(self, symbols: list[int]) -> list[int]:
        rule, out = self.rule, list(symbols)
        found = [rule.get(p) for p in zip(out, out[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(found):
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                return out
            out[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = rule.get((out[at], out[at + 1]))
            if at:
                found[at - 1] = rule.get((out[at - 1], out[at]))

    def _large(self, symbols: list[int]) -> list[int]:
        rule, out, n = self.rule, list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, out[i], out[i + 1]) for i in range(n - 1) if (r := rule.get((out[i], out[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j >= n or out[j] != b:
                continue
            out[i], out[j] = rule[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rule.get((out[i], out[k])):
                    heapq.heappush(heap, (r[0], i, out[i], out[k]))
            if (h := before[i]) >= 0 and (r := rule.get((out[h], out[i]))):
                heapq.heappush(heap, (r[0], h, out[h], out[i]))
        return [x for x in out if x >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """The same ids, each emitted once nothing behind it can change it; holds ``buffer`` symbols at most."""
        held: list[int] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) < self.buffer:
                continue
            settled, end = len(held) - self.lookahead, 0
            for token in self.merged(held):
                if end + self.width[token] > settled:
                    break
                end += self.width[token]
                yield token
            held = held[end:]
        yield from self.merged(held)


class WordVocabulary:
    """A vocabulary with word ends: NFC, lower case, words by pattern, letters for bytes."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model, suffix = parts["model"], parts["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + suffix] for c in letters]
        width = {i: 1 for i in [*self.inner, *self.last]}
        merges = []
        for left, right in model["merges"]:
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            width[made] = width[a] + width[b]
            merges.append((a, b, made))
        self.merger = Merger(merges, width)
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE)
        self.word = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        byte_of = {c: b for b, c in enumerate(letters)}
        self.token_bytes = [
            t.encode() if i in self.special.values()
            else bytes(byte_of[c] for c in t.removesuffix(suffix)) + b" " * t.endswith(suffix)
            for i, t in enumerate(self.tokens)
        ]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def word_ids(self, word: str) -> list[int]:
        """ids of one pre-token."""
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.last[data[-1]])
        merger = self.merger
        return merger.merged(symbols) if len(symbols) < merger.buffer else list(merger.stream(symbols))

    def _plain_ids(self, text: str) -> list[int]:
        if not text.isascii():
            # Lower-casing goes letter by letter: no special final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        out: list[int] = []
        for word in self.word.findall(text.lower()):
            out += self.word_ids(word)
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        """ids of a text without blanks at which it could be cut; special tokens are taken out first."""
        ids: list[int] = []
        for part in self.cut.split(chunk) if "<" in chunk else [chunk]:
            if part:
                ids += [self.special[part]] if part in self.special else self._plain_ids(part)
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """ids as little-endian 32-bit integers; ids of short chunks are kept in a table of bounded size."""
        chunks = word_chunks(text)
        known = self.known
        if len(known) > MAX_CHUNKS:
            self.older, known = known, {"": b""}
            self.known = known
        long: dict[str, bytes] = {}
        for chunk in [c for c in set(chunks) if c not in known]:
            ids = self.older.get(chunk)
            ids = self.chunk_ids(chunk) if ids is None else ids
            (known if len(chunk) <= LONGEST_KEPT else long)[chunk] = ids
        if long:
            return b"".join([known[c] if len(c) <= LONGEST_KEPT else long[c] for c in chunks])
        return b"".join([known[c] for c in chunks])


class ByteToText:
    """Bytes in, text out; the bytes of an unfinished character wait for the next call."""

    def __init__(self):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode_stream(ids: np.ndarray, pieces: np.ndarray, separator: bytes = b"") -> Iterator[str]:
    """Text of ids, slice by slice. ``pieces`` has each id's bytes, ``separator`` stands between two ids."""
    out = ByteToText()
    for at in range(0, len(ids), IDS_AT_ONCE):
        data = separator.join(pieces[ids[at : at + IDS_AT_ONCE]].tolist())
        yield out.feed(separator + data if at else data)
    yield out.finish()


_loaded: dict[tuple[str, int], WordVocabulary] = {}


def vocabulary(spec: str) -> WordVocabulary:
    """The worker's tables for a vocabulary; they stay between tasks."""
    key = (spec[-64:], len(spec))
    if key not in _loaded:
        _loaded[key] = WordVocabulary(spec)
    return _loaded[key]


def encode_documents(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id and ids (array<int>), one row per input row.

    A null or empty text has no ids. Equal or null doc_ids stay rows of their
    own; other columns are not read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                got = [words.encode(t or "") for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(g) // 4 for g in got]], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, spec: str, as_text: bool = False) -> DataFrame:
    """doc_id, ids and decoded text. Null ids decode as none.

    The vocabulary names no decoder, so by default the decoded text is the
    tokens' own letters with a blank between two of them; ``as_text`` gives the
    bytes behind the letters instead, with a blank for every word end.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(spec)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(sent.value)
        pieces = np.array(words.token_bytes if as_text else [t.encode() for t in words.tokens], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                ids = pc.fill_null(some.column(1).flatten(), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(some.column(1)), 0).to_pylist()])
                texts = [
                    "".join(decode_stream(ids[a:b], pieces, b"" if as_text else b" "))
                    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
                )

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, ids array<int>, decoded string")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    spec = public_vocabulary("word_bpe_49k.json")
    out = decode_documents(encode_documents(documents_of(spark, folder), spec), spec)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
