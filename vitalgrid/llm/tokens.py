"""Whole texts to ids as the tokenizers library gives them, one distinct chunk at a time.

Both vocabularies pre-split a text at white space before any merge, so a text's
ids are the ids of its chunks, one after another. Chunks repeat a lot; their ids
are kept per worker process in a table of bounded size.

* ``word``: white space never reaches a token, so a text is cut at every blank
  and line feed.
* ``byte``: a token may begin with one blank. A blank with a visible character
  behind it always begins a pre-token (a longer run of white space gives up its
  last blank), so a text is cut before each such blank. Where the merge list
  numbers its results in order, chunks go to tiktoken, which merges by the same
  numbers in a tenth of the time.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

MAX_CHUNKS = 700_000
JOINED = 400
LONGEST_KEPT = 64
#: Fixed value: what the byte-level pre-tokenizer splits by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK_THEN_SPACE = re.compile(r" (?:\s|$)")
_VISIBLE_NEXT = re.compile(r" (?=\S)")
_loaded: dict[tuple[str, int], ChunkEncoder] = {}


def tokenizer_json(path: str) -> str:
    """The vocabulary file as text (a few MB at most), to be sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def word_chunks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def byte_chunks(text: str) -> list[str]:
    parts = text.split(" ") if not _BLANK_THEN_SPACE.search(text) else _VISIBLE_NEXT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the letters from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranked_encoding(parts: dict):
    """A tiktoken encoding for a byte-level vocabulary, or None where merges and ids are not in one order."""
    model, level = parts["model"], parts["pre_tokenizer"]
    if level["type"] != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True) or parts.get("normalizer"):
        return None
    if model.get("ignore_merges") or model.get("dropout") or model.get("unk_token"):
        return None
    letters, special = byte_of_letter(), {t["content"] for t in parts["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if made != sorted(set(made)) or any(c not in model["vocab"] for c in letters) or len(merges) + 256 + len(special & model["vocab"].keys()) != len(model["vocab"]):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    Chunks not seen before go to the library joined by a special token, which it
    takes out of a text before anything else; its id parts the ids again.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(spec)
        self.chunks = byte_chunks if parts["pre_tokenizer"]["type"] == "ByteLevel" else word_chunks
        special = parts["added_tokens"][-1]
        self.separator, self.separator_id = special["content"], special["id"]
        self.ranked = ranked_encoding(parts)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _fresh(self, chunks: list[str]) -> None:
        if self.ranked is not None:
            encode = self.ranked.encode_ordinary
            for chunk in chunks:
                if self.separator not in chunk:
                    self.known[chunk] = array("I", encode(chunk)).tobytes()
            self._one_by_one([c for c in chunks if self.separator in c])
            return
        plain = [c for c in chunks if self.separator not in c]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        got = self.tokenizer.encode_batch_fast([self.separator.join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, got, strict=True):
            ids = np.array(encoding.ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.separator_id).tolist(), len(ids)]
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(group, ends, strict=True):
                self.known[chunk] = raw[4 * start : 4 * end]
                start = end + 1
        self._one_by_one([c for c in chunks if self.separator in c])

    def _one_by_one(self, chunks: list[str]) -> None:
        for chunk in chunks:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            self.known[chunk] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        if len(self.known) > MAX_CHUNKS:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        missing = []
        for chunk in [c for c in set().union(*split) if c not in known]:
            ids = older.get(chunk)
            if ids is None:
                missing.append(chunk)
            else:
                known[chunk] = ids
        for at in range(0, len(missing), 50_000):
            self._fresh(missing[at : at + 50_000])
        out = [b"".join([known[c] for c in chunks]) for chunks in split]
        for chunk in missing:
            if len(chunk) > LONGEST_KEPT:
                del known[chunk]
        return out


def chunk_encoder(spec: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary; it stays between tasks."""
    key = (spec[-64:], len(spec))
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(spec)
    return _loaded[key]
