"""Per-text statistics computed over whole texts with byte tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes; each gives the share of a text's bytes that fall into it.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\f\v",
    "line_feed": b"\n",
    "full_stop": b".",
    "comma": b",",
    "shout": b"!?",
    "symbol": b"#$%&*+=@^~",
    "bar": b"|<>\\/_",
    "bracket": b"()[]{}",
    "quote": b"\"'`-:;",
    "high": bytes(range(128, 256)),
}
NAMES = [
    *CLASSES, "log_bytes", "word_bytes", "line_bytes", "upper_in_letters", "symbol_words", "new_words", "new_lines",
]

_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS_OF[list(_members)] = _i


def _distinct_share(parts: list[bytes]) -> float:
    return len(set(parts)) / len(parts) if parts else 1.0


def text_features(texts: pa.Array) -> np.ndarray:
    """(n, len(NAMES)) matrix. Null and empty texts give zeros but for the two shares of distinct parts, which are 1."""
    out = np.zeros((len(texts), len(NAMES)))
    k = len(CLASSES)
    for i, text in enumerate(pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()):
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        out[i, k + 5], out[i, k + 6] = _distinct_share(words), _distinct_share(lines)
        if not text:
            continue
        data = np.frombuffer(text, np.uint8)
        shares = np.bincount(_CLASS_OF[data], minlength=k + 1)[:k] / len(data)
        out[i, :k] = shares
        out[i, k] = np.log1p(len(data))
        out[i, k + 1] = np.log1p(len(data) / max(1, len(words)))
        out[i, k + 2] = np.log1p(len(data) / max(1, len(lines)))
        letters = shares[0] + shares[1]
        out[i, k + 3] = shares[0] / letters if letters else 0.0
        out[i, k + 4] = min(1.0, (shares[7] + shares[8] + shares[9]) * len(data) / max(1, len(words)))
    return out
