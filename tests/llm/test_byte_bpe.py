"""Byte-level BPE against the library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from critiq.llm import byte_bpe
from critiq.llm.byte_bpe import Merger, Vocabulary, bpe_decode, bpe_encode, bpe_round_trip, merge, read_ranks, slices

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
MERGER = Merger(Vocabulary(RANKS))
PIECES = [*"ab Zé1２ \n\t  '’.,!stmdrevl中文́½Ⅷ🙂-\r\x0b\x85", "'s", "'re", "'ll ", "  ", "' ", "''", "'v", "'l"]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_slices_equal_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(4000)]
    assert list(slices(texts)) == [PATTERN.findall(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(st.sampled_from(" 'stlvered\n\tA1.é"), max_size=60)), max_size=5))
def test_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [ids(x) for x in MERGER.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["ab" * 3000, "a" * 1000, " " * 900, "!?" * 400, "é" * 300, "x" * 47 + "é", "x" * 49, ("word " * 30 + "\n\n'll") * 200])
def test_long_slices_and_state_over_pieces(monkeypatch, text):
    monkeypatch.setattr(byte_bpe, "PIECE", 97)
    assert ids(MERGER.encode([text])[0]) == LIBRARY.encode_ordinary(text)
    assert list(slices([text, "", "'s", text])) == [PATTERN.findall(t) for t in (text, "", "'s", text)]


def test_ways_of_merging_agree():
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choices(b"abcdethino rs", k=rng.randint(2, 30)))
        assert merge(piece, RANKS) == (byte_bpe._merge_long(piece, RANKS) if piece not in RANKS else [RANKS[piece]])


def test_every_code_point_of_the_lower_planes():
    points = [c for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000)] if not 0xD800 <= c < 0xE000]
    texts = [f"a1{chr(c)}a{chr(c)}1{chr(c)}! {chr(c)}" for c in points]
    assert [ids(x) for x in MERGER.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_frames(spark):
    rows = [(1, "It's   fine\n\n ok", "x"), (1, "again", "y"), (None, "no id", None), (3, None, "z"), (4, "", "z"), (5, "long " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_encode(docs, PATH)
    back = bpe_decode(got, PATH)
    want = sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect()) == want
    for r in got.collect():
        sizes = [len(LIBRARY.decode_single_token_bytes(i)) for i in ids(r.ids)]
        assert ids(r.offsets) == [sum(sizes[:k]) for k in range(len(sizes))] or len(sizes) > 1000
    assert bpe_decode(bpe_encode(docs.limit(0), PATH, offsets=False), PATH).count() == 0


def test_offsets_place_the_bytes(spark):
    rows = [(1, "It's   fine\n\n ok é中"), (None, "no id"), (3, None), (4, ""), (5, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), (t or "").encode()) for i, t in rows)
    whole = bpe_round_trip(docs, PATH)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in whole.collect()) == want
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe_decode(whole, PATH, offsets_col="offsets").collect()) == want
    part = whole.filter("doc_id = 1").selectExpr("doc_id", "substr(ids, 9) ids", "substr(offsets, 9) offsets")
    first = sum(len(LIBRARY.decode_single_token_bytes(i)) for i in LIBRARY.encode_ordinary(rows[0][1])[:2])
    assert bytes(bpe_decode(part, PATH, offsets_col="offsets").first().decoded) == rows[0][1].encode()[first:]
    broken = whole.filter("doc_id = 1").selectExpr("doc_id", "ids", "concat(substr(offsets, 5), x'09000000') offsets")
    with pytest.raises(Exception, match="offsets do not fit"):
        bpe_decode(broken, PATH, offsets_col="offsets").collect()


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 50_000)
    merger = Merger(Vocabulary(RANKS))
    for k in range(40):
        texts = [f" w{k * 100 + j}x" for j in range(100)]
        assert [ids(x) for x in merger.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
        assert merger.size <= 50_000 + 100 * 400 and len(merger) <= 900
