"""Encoding, packing and id files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitalgrid.llm.bpe import ByteToText, Merger, WordVocabulary, decode_documents, encode_documents
from vitalgrid.llm.id_files import pack_ids, read_id_files, unpack_ids, write_id_files
from vitalgrid.llm.packing import best_fit, pack_documents, public_vocabulary
from vitalgrid.llm.tokens import ChunkEncoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [
    "  a  b   c \n d\n\n  e", "<|endoftext|> x <|endoftext|>y<|startoftext|>", "a\x1c b  c 　d", "trail  ",
    "İSTANBUL ΣΑΣ ς don't I'LL 's", "á ́b é", "Ǆ ǅ ﬁ ẞ \x00 ²Ⅷ", "a" * 3000, "é" * 2000, "the" * 1500,
]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in (WORD, BYTE)}


@pytest.fixture(scope="module")
def words():
    return WordVocabulary(public_vocabulary(WORD))


def expected(library, name, text, end=None):
    ids = library[name].encode(text or "", add_special_tokens=False).ids
    return ids if end is None else [*ids, end]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\taAbéZ'sΣ1.!\x1c日😀́ ᠎İ<|>")), max_size=40))
def test_chunks_and_words_equal_the_library(text):
    for name, encoder in _encoders().items():
        assert np.frombuffer(encoder(text), "<u4").tolist() == _library(name).encode(text, add_special_tokens=False).ids


_kept = {}


def _library(name):
    return _kept.setdefault(("lib", name), Tokenizer.from_file(public_tokenizers.path(name)))


def _encoders():
    if "enc" not in _kept:
        byte = ChunkEncoder(public_vocabulary(BYTE))
        own = WordVocabulary(public_vocabulary(WORD))
        _kept["enc"] = {BYTE: lambda t: byte.encode([t])[0], WORD: own.encode}
    return _kept["enc"]


def test_odd_texts(library, words):
    for name in (WORD, BYTE):
        encoder = ChunkEncoder(public_vocabulary(name))
        for text, got in zip(ODD, encoder.encode(ODD), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == expected(library, name, text)
    for text in ODD:
        assert np.frombuffer(words.encode(text), "<i4").tolist() == expected(library, WORD, text)


def random_merges(rng):
    strings, width, merges = {i: (i,) for i in range(3)}, {i: 1 for i in range(3)}, []
    for _ in range(rng.randint(1, 14)):
        a, b = rng.choice(list(strings)), rng.choice(list(strings))
        made = strings[a] + strings[b]
        if len(made) <= 6 and made not in strings.values():
            i = len(strings)
            strings[i], width[i] = made, len(made)
            merges.append((a, b, i))
    return merges, width


def test_lookahead_suffices():
    rng = random.Random(8)
    for _ in range(400):
        merger = Merger(*random_merges(rng))
        merger.buffer = merger.lookahead + max(merger.width.values()) + 1
        for _ in range(5):
            symbols = [rng.randrange(3) for _ in range(rng.randint(1, 150))]
            assert list(merger.stream(iter(symbols))) == merger._small(symbols) == merger._large(symbols)


def test_decoder_waits_for_whole_characters():
    state, data = ByteToText(), "aé日😀".encode()
    assert "".join(state.feed(data[i : i + 1]) for i in range(len(data))) + state.finish() == "aé日😀"
    assert state.feed(b"\xe6\x97") == "" and state.finish() == "�"


def test_encode_and_decode_documents(documents, library):
    rows = [*AWKWARD, *[(100 + i, t) for i, t in enumerate(ODD)]]
    spec = public_vocabulary(WORD)
    encoded = encode_documents(documents(rows), spec)
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in decode_documents(encoded, spec).collect()]
    want = []
    for i, text in rows:
        ids = expected(library, WORD, text)
        want.append((i, tuple(ids), library[WORD].decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=str) == sorted(want, key=str)
    plain = {r.doc_id: r.decoded for r in decode_documents(encoded, spec, as_text=True).collect()}
    assert plain[4] == "one " and plain[12].startswith("日本語 テキスト é é")
    assert decode_documents(encode_documents(documents([]), spec), spec).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 4000)
    at, offset, opened = best_fit(lengths)
    used = np.bincount(at, weights=lengths, minlength=opened)
    assert used.max() <= 1024 and 1 - lengths.sum() / (1024 * opened) < 0.01
    order = np.lexsort((offset, at))
    gaps = offset[order][1:] - (offset[order] + lengths[order])[:-1]
    assert (gaps[at[order][1:] == at[order][:-1]] == 0).all()


def test_best_fit_chooses_the_least_room():
    at, offset, opened = best_fit(np.array([6, 7, 3, 4]), window=10)
    assert opened == 2 and at.tolist() == [1, 0, 0, 1] and offset.tolist() == [0, 0, 7, 6]


def test_packed_pieces(documents, library):
    rows = [*AWKWARD, *[(100 + i, t) for i, t in enumerate(ODD)]]
    pieces = pack_documents(documents(rows), public_vocabulary(BYTE), window=64, block=7).toPandas()
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 64 and (pieces["offset"] + pieces["length"]).groupby(pieces["sequence_id"]).max().equals(filled)
    joined = {}
    for p in pieces.sort_values("start").itertuples():
        assert len(p.ids) == 4 * p.length
        joined.setdefault((None if np.isnan(p.doc_id) else int(p.doc_id), p.doc_tokens), []).append(p)
    for i, text in rows:
        if i in (9, None):
            continue  # ids on several rows: counted below
        ids = expected(library, BYTE, text, 0)
        mine = joined[i, len(ids)]
        assert [p.start for p in mine] == np.cumsum([0, *[p.length for p in mine]])[:-1].tolist()
        assert b"".join(p.ids for p in mine) == np.array(ids, "<u4").tobytes()
    assert pieces["length"].sum() == sum(len(expected(library, BYTE, t, 0)) for _, t in rows)
    assert pack_documents(documents([]), public_vocabulary(BYTE)).count() == 0


@pytest.mark.parametrize(
    "ids",
    [
        np.zeros(0, int), np.array([0]), np.array([65534] * 10), np.zeros(9000, int), np.arange(20000) % 49408,
        np.random.default_rng(1).integers(0, 65535, 9000), np.random.default_rng(2).zipf(1.3, 9000) % 49408,
        np.tile(np.random.default_rng(3).integers(0, 49000, 50), 300),
    ],
    ids=["none", "one", "largest", "zeros", "count", "uniform", "zipf", "cycle"],
)
def test_range_coder_round_trip(ids):
    assert unpack_ids(pack_ids(ids)).tolist() == ids.tolist()


def test_range_coder_compresses_and_checks():
    ids = np.random.default_rng(2).zipf(1.3, 20000) % 49408
    data = pack_ids(ids)
    assert len(data) < 1.4 * len(ids)
    cycle = np.random.default_rng(3).permutation(49_000)[:50]  # every id tells the next one
    assert len(pack_ids(np.tile(cycle, 400))) < len(data) / 8
    broken = bytearray(data)
    broken[-200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        unpack_ids(bytes(broken))


def test_id_files(documents, library, spark, tmp_path):
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 9] + [(100 + i, t) for i, t in enumerate(ODD)]
    path = str(tmp_path / "ids")
    write_id_files(documents(rows), path, public_vocabulary(WORD), segment_ids=3000)
    got = {r.doc_id: r for r in read_id_files(spark, path).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = expected(library, WORD, text, 1)
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)
    again = str(tmp_path / "again")
    write_id_files(documents([(9, "a"), (9, "a"), (None, None)]), again, public_vocabulary(WORD))
    assert sorted((r.start, r.n_tokens, zlib.crc32(r.ids) > 0) for r in read_id_files(spark, again).collect()) == [
        (0, 1, True), (1, 2, True), (3, 2, True),
    ]
    empty = str(tmp_path / "empty")
    write_id_files(documents([]), empty, public_vocabulary(WORD))
    assert read_id_files(spark, empty).count() == 0
