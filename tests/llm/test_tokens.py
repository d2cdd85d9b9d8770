"""Token files against encoding each text on its own."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import queries, tokens
from tidewatch.llm.common import slices_of_bytes, small_batches, word_hashes

ODD = [
    None, "", " ", "a b", "It's  O'Neil's x y", "<|endoftext|> foo<|startoftext|>bar", "ÀÉ eͤ é x ́y",
    "ΣΑΣ ΑΣ. İstanbul", "漢字 テスト\tfoo\x0bbar\x1cbaz", "a" * 3000, "zero 😀😀 !!! ...", "ª º µ ß ẞ ﬁ", "x\x85y z\x00w",
    "123 4,5 '' 's 'S", "Word, word. WORD! wörd; word's", "tab\tand\nline\r\nend",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def expected(tokenizer, texts, end=1):
    out, start = [], 0
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end] * (end is not None)
        out.append((start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_round_trip_of_odd_texts(spark, tokenizer, tmp_path):
    rows = [(k, text, "x") for k, text in enumerate(ODD)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    folder = str(tmp_path / "tokens")
    manifest = tokens.write_tokens(df, folder, queries.tokenizer_path())
    assert manifest["dtype"] == "<u2" and sum(p["docs"] for p in manifest["parts"]) == len(ODD)
    got = tokens.read_tokens(spark, folder, ids=True).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(tokenizer, ODD)


def test_files_are_flat_and_offsets_go_through(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(k, "some words " * (k % 5)) for k in range(40)], "doc_id long, text string")
    tokens.write_tokens(df, str(tmp_path), queries.tokenizer_path(), end_id=None)
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    data, offsets = [], [0]
    for part in manifest["parts"]:
        name = tmp_path / f"part-{part['part']:05d}"
        data += np.memmap(f"{name}.bin", "<u2", "r").tolist() if part["ids"] else []
        own = np.fromfile(f"{name}.idx", "<u8")
        assert own[0] == part["base"] == offsets[-1]
        offsets += own[1:].tolist()
    wanted = expected(tokenizer, ["some words " * (k % 5) for k in range(40)], None)
    assert data == [i for x in wanted for i in x[3]]
    assert offsets[:-1] == [x[0] for x in wanted]


def test_ties_nulls_and_nothing(spark, tokenizer):
    rows = [(2, "b"), (2, "a"), (None, "n"), (1, "c"), (2, "a"), (-5, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.tokens_of(df, queries.tokenizer_path()).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -5, 1, 2, 2, 2]
    assert [r["start"] for r in got] == [0, 2, 4, 6, 8, 10]
    assert tokens.tokens_of(df.limit(0), queries.tokenizer_path()).collect() == []


def test_memory_is_bounded(tokenizer):
    encoder = tokens.Encoder(queries.tokenizer_path(), limit=20)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc dE.,\n", k=300)) for _ in range(50)]
    for k in range(0, 50, 10):
        got = encoder.encode(texts[k:k + 10])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == (
            [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k:k + 10]])
    assert len(encoder.chunks) <= 20 and len(encoder.words) <= 20


def test_words_need_no_normalizing(tokenizer):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(6000)] + list(letters)
    assert all(tokens._PLAIN.fullmatch(w)[1].lower() == w for w in words)
    got = tokens.Encoder(queries.tokenizer_path()).word_ids(words)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in got] == [
        tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_long_texts_and_clashing_columns(spark, tokenizer):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdé,.", k=6)) for _ in range(40_000)), "short", None, "漢" * 30_000]
    rows = [(k, t, 7, "x", 1.0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, n_tokens string, word double")
    got = tokens.tokens_of(df, queries.tokenizer_path()).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [x[:3] for x in expected(tokenizer, texts)]


def test_parts_of_files_are_read(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.bin")
    np.arange(1000, dtype="<u2").tofile(path)
    local, other = fs.LocalFileSystem(), fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    for store in (local, other):
        assert tokens._values(store, path, "<u2", 17, 30).tolist() == list(range(17, 30))
        assert tokens._values(store, path, "<u2", 5, 5).tolist() == []


def test_paths_are_resolved_like_sparks(spark):
    assert tokens.resolved(spark, "/a/b") == "file:/a/b" and tokens.resolved(spark, "file:///a") == "file:/a"
    assert tokens._open("file:/a/b")[1] == "/a/b"


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    assert not encoder.word_at_a_time
    text = "Two words, and  spaces\n"
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == (
        Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_a_worker_gives_back_what_other_operators_remembered(spark, tmp_path, tokenizer):
    word_hashes.of([b"%d" % k for k in range(1000)])
    tokens.encoder.cache_clear()
    few = tokens.encoder(queries.tokenizer_path(), 50)
    assert len(word_hashes) == 0 and few.limit == 50
    texts = [f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} common" for k in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokens.tokens_of(df, queries.tokenizer_path(), remembered=50).orderBy("doc_id").collect()
    assert [tuple(r)[1:4] for r in got] == [x[:3] for x in expected(tokenizer, texts)]


def test_batches_of_texts_are_small(spark):
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    small_batches(spark)
    sizes = spark.createDataFrame([("x" * 100_000,)] * 300, "t string").coalesce(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    for k, v in before.items():
        spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
    assert sum(r["n"] for r in sizes) >= 30_000_000 and max(r["n"] for r in sizes) < 8_000_000


def test_only_different_words_leave_arrow(tokenizer):
    rng = random.Random(4)
    parts = ["word", "Word", "WÖRD", "wörd", "ßÿ", "", "x" * 41, "É" * 40, "4.0.", "a|b", "\ttab", "a\u0301", "漢字", "<|endoftext|>"]
    texts = [rng.choice(" \n").join(rng.choice(parts) + rng.choice(["", ".", "?!", "$" * 9]) for _ in range(rng.randrange(30)))
             for _ in range(300)]
    encoder = tokens.Encoder(queries.tokenizer_path())
    asked = []
    find = encoder.word_ids
    encoder.word_ids = lambda words: asked.extend(words) or find(words)
    for given in (texts, pa.array(["cut", *texts]).slice(1), []):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(given)] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in (texts if len(given) else [])]
    assert sorted(asked) == sorted({"word", "wörd", "ßÿ", "é" * 40}) and not set(encoder.chunks) & {"word", "Word.", "WÖRD?!"}


def test_slices_are_cut_by_bytes():
    texts = ["aa", None, "b" * 9, "", "é" * 3, "c", None, "d" * 30, "e"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts)})
    for most in (1, 4, 7, 1000):
        got = list(slices_of_bytes(iter([batch.slice(0, 0), batch, batch.slice(2, 3)]), 1, most))
        assert [x for b in got for x in b.column(1).to_pylist()] == texts + texts[2:5]
        for b in got:
            sizes = [len((t or "").encode()) for t in b.column(1).to_pylist()]
            assert b.num_rows and sum(sizes) - max(sizes) <= most
