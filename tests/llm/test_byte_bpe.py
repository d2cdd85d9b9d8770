"""Byte-level BPE against the tiktoken library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

ODD = [
    None, "", " ", "   \n\n  x", "It's we'll 'sx 'S", "<|endoftext|> foo<|endoftext|>", "ÀÉ eͤ é x ́y", "漢字 テスト\tfoo\x0bbar\x1cbaz",
    "zero 😀😀👩‍👩‍👧 !!! ...", "ª º µ ß ẞ ﬁ", "x\x85y z\x00w v᠎", "123 4,5 ½ ٣٤", "a" * 3000, " " * 3000 + "b", "\n" * 999, "tab\tand\r\nend ",
    "�﻿\U0010ffff", "".join(map(chr, range(1, 700))),
]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(byte_bpe.tokenizer_json(PATH, PATTERN), PATTERN)


def long_text(seed, n=40_000):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé漢'😀1-", k=rng.randrange(1, 12))) for _ in range(500)]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ". ", ""]) for _ in range(n))


def test_byte_table():
    table = byte_bpe.byte_characters()
    assert len(set(table)) == 256 and table[ord("a")] == "a" and table[ord(" ")] == "Ġ" and table[ord("\n")] == "Ċ"


def test_every_token_is_merged_from_two(own):
    ranks = byte_bpe.read_ranks(PATH)
    for token, rank in ranks.items():
        if len(token) > 1:
            a, b = byte_bpe.last_pair(token, ranks)
            assert a + b == token and max(ranks[a], ranks[b]) < rank
    assert own.bytes_of == {rank: token for token, rank in ranks.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("a's 1\n\té漢!", max_size=60))
def test_any_text(oracle, own, text):
    ids = own.encode(text)
    assert ids.tolist() == oracle.encode_ordinary(text)
    assert own.decode_bytes(ids) == text.encode() and "".join(own.decode_pieces(ids)) == text


@pytest.mark.parametrize("seed", range(3))
def test_sections_change_nothing(oracle, own, seed):
    text = long_text(seed)
    assert len(list(byte_bpe.sections(text))) > 2
    assert own.encode(text).tolist() == oracle.encode_ordinary(text)
    for odd in ("x" * 100_000, " " * 100_000, "!?" * 50_000, "漢" * 70_000 + "。" + "字" * 70_000, "don't" * 20_000):
        assert "".join(part for _, part in byte_bpe.sections(odd)) == odd
        assert b"".join(map(own.bytes_of.get, own.encode(odd).tolist())) == odd.encode()
    assert own.encode("don't" * 9_000).tolist() == oracle.encode_ordinary("don't" * 9_000)


def test_memory_is_bounded(oracle):
    own = byte_bpe.Codec(byte_bpe.tokenizer_json(PATH, PATTERN), PATTERN, limit=50)
    for seed in range(30):
        texts = [long_text(seed, 30), "x" * 100 + " y", long_text(seed % 3, 30)]
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_batch(texts)]
        assert got == [oracle.encode_ordinary(t) for t in texts]
        assert len(own.known) <= 50 and len(own.older) <= 50 + 100


def test_offsets(own):
    for text in [t for t in ODD if t] + [long_text(9)]:
        ids, at = own.encode_with_offsets(text)
        assert ids.tolist() == own.encode(text).tolist()
        ends = np.cumsum([len(c.encode()) for c in text])
        done = 0
        for i, (start, end) in zip(ids.tolist(), at.tolist()):
            first, done = done, done + len(own.bytes_of[i])
            assert start == np.searchsorted(ends, first, side="right") and end == np.searchsorted(ends, done - 1, side="right") + 1
        assert done == len(text.encode())


def test_tables(spark, oracle):
    rows = [(k, t, 1, "x", "y") for k, t in enumerate([*ODD, long_text(3), "twice", "twice"])] + [(None, "null id", 1, "x", "y"), (3, "again", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string, starts string").repartition(3)
    got = byte_bpe.round_trip(docs, PATH, PATTERN).collect()
    want = []
    for k, text, *_ in rows:
        ids = oracle.encode_ordinary(text or "")
        want.append((k, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    encoded = byte_bpe.encode(docs, PATH, PATTERN)
    decoded = byte_bpe.decode(encoded, PATH, PATTERN).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in decoded))) == sorted(repr((k, t or "")) for k, t, *_ in rows)
    assert byte_bpe.round_trip(docs.limit(0), PATH, PATTERN).collect() == []


def test_decoding_odd_ids(spark):
    ranks = byte_bpe.read_ranks(PATH)
    face = [ranks[bytes([b])] for b in "😀".encode()]
    rows = [(1, face), (2, face[:2]), (3, [None, 10**9, ranks[b"a"]]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>")
    got = {r["doc_id"]: (r["text"], r["pieces"]) for r in byte_bpe.decode(df, PATH, PATTERN).collect()}
    assert got[1] == ("😀", ["", "", "", "😀"])
    assert got[2][0] == "�" and got[3][0] == "��a" and got[4] == (None, None) and got[5] == ("", [])


def test_query(spark, tables, oracle):
    got = queries.op12_byte_bpe(spark, tables).collect()
    texts = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    want = [(k, len(ids := oracle.encode_ordinary(t or "")), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts]
    assert sorted(map(tuple, got)) == sorted(want)
