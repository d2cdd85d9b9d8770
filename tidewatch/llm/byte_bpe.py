"""Byte-level BPE by a table of ranks, with offsets, and its inverse.

A rank file has one token per line: its bytes in base 64 and its rank, which is also its id. The tokenizers library
works on characters, so each byte stands as one character of a fixed table, and its merges are pairs, so each
token is taken apart into the pair that its ranks merge last. The text is cut by a pattern first; each match is
encoded on its own, and a match that is a token itself needs no merges.

Long texts go to the library in sections. A section ends between a letter and something that is no letter,
where no match of the pattern goes on, so sections change nothing but the memory needed.

Matches come again and again, so a worker remembers their ids. Only unknown matches go to the library, many in one call,
each as a word of its own. What is remembered has a bound: when the newer half of it is full, the older half goes.

Decoding looks the bytes of each id up and joins them. A character's bytes may lie in several tokens: ``decode``
gives such a character to the token that completes it.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, without_cache

#: The bytes that stand as the character of their own number; the others follow from 256 on, in order.
_OWN = (range(33, 127), range(161, 173), range(174, 256))

#: Characters of a text that go to the library at once, at least; a section ends at the next possible place.
SECTION = 1 << 15

#: What ids outside the vocabulary decode to: the replacement character.
UNKNOWN = "�".encode()

_CUT = regex.compile(r"\p{L}(?!\p{L})")


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    own = {b for run in _OWN for b in run}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are merged last when ``token``'s bytes are merged by rank; None if that never gives it."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@cache
def tokenizer_json(path: str, pattern: str) -> str:
    """The rank file as a description for the tokenizers library."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, characters = read_ranks(path), byte_characters()
    name = {token: "".join(map(characters.__getitem__, token)) for token in ranks}
    pairs = [last_pair(token, ranks) for token in sorted(ranks, key=ranks.get)]
    tokenizer = Tokenizer(models.BPE(
        vocab={name[token]: rank for token, rank in ranks.items()},
        merges=[(name[p[0]], name[p[1]]) for p in pairs if p],
        ignore_merges=True,
    ))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


def sections(text: str) -> Iterator[tuple[int, str]]:
    """The text in sections with their places."""
    start = 0
    while len(text) - start > SECTION:
        cut = _CUT.search(text, start + SECTION - 1)
        if cut is None:
            break
        yield start, text[start:cut.end()]
        start = cut.end()
    yield start, text[start:]


class Codec:
    """Encodes and decodes; one per Python worker and description."""

    def __init__(self, description: str, pattern: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(description)
        self.words = without_cache(Tokenizer.from_str(description))
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = regex.compile(pattern).findall
        number = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = {i: bytes(map(number.__getitem__, token)) for token, i in vocabulary.items()}
        self.table = np.full(max(self.bytes_of) + 2, UNKNOWN, object)  # the last entry is for all ids beyond
        self.table[list(self.bytes_of)] = list(self.bytes_of.values())
        self.limit, self.known, self.older = limit, {}, {}

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        """The ids of matches, as little-endian unsigned 32-bit integers."""
        out = {}
        for start in range(0, len(matches), 5000):
            some = matches[start:start + 5000]
            found = self.words.encode(some, is_pretokenized=True, add_special_tokens=False)
            data = np.asarray(found.ids, "<u4").tobytes()
            ends = np.searchsorted(np.asarray(found.word_ids), np.arange(len(some)), side="right").tolist()
            out |= {match: data[4 * a:4 * b] for match, a, b in zip(some, [0, *ends], ends)}
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        known, older = self.known, self.older
        split = list(map(self.matches, texts))
        new = set().union(*split).difference(known)
        known |= {match: older[match] for match in new if match in older}
        known |= self._learn([match for match in new if match not in known])
        out = [b"".join(map(known.__getitem__, matches)) for matches in split]
        for match in new:
            if len(match) > 64:
                del known[match]
        if len(known) > self.limit:
            self.known, self.older = {}, known
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], "<u4")

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and per id the characters that have a byte in it, as (first, end)."""
        ids, offsets = [], []
        for start, part in sections(text):
            found = self.tokenizer.encode(part, add_special_tokens=False)
            ids.append(np.asarray(found.ids, "<u4"))
            offsets.append(np.asarray(found.offsets, np.int64).reshape(-1, 2) + start)
        return np.concatenate(ids), np.concatenate(offsets)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[np.minimum(ids, len(self.table) - 1)])

    def decode_pieces(self, ids: np.ndarray) -> list[str]:
        """The text of each id; a character goes to the id with its last byte, bytes of none become U+FFFD."""
        table, reader = self.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")
        pieces = [reader.decode(table.get(i, UNKNOWN)) for i in ids.tolist()]
        if pieces:
            pieces[-1] += reader.decode(b"", True)
        return pieces


@cache
def codec(description: str, pattern: str) -> Codec:
    return Codec(description, pattern)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, starts, ends) of every row of ``docs`` (doc_id, text).

    ``path`` is a rank file that the driver can read; workers get its content. A token holds the characters
    ``starts`` to ``ends`` (exclusive) in part or whole, so neighbours may share a character. A null text is empty
    and gives empty arrays; rows with null or equal ids are all kept; other columns are ignored, whatever their
    names; no rows give no rows. A task holds a batch of texts and the tokens of one of them.
    """
    description = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(description.value, pattern)
        for batch in slices(batches, 64):
            found = [own.encode_with_offsets(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "ids": pa.array([ids.astype(np.int32) for ids, _ in found], kind),
                "starts": pa.array([at[:, 0].astype(np.int32) for _, at in found], kind),
                "ends": pa.array([at[:, 1].astype(np.int32) for _, at in found], kind),
            })

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text, pieces) of rows (doc_id, ids): the text, and what each id adds to it.

    Null ids give a null text. Bytes that are no UTF-8 and ids (or nulls among them) outside the vocabulary become U+FFFD.
    """
    description = encoded.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(description.value, pattern)
        for batch in slices(batches, 64):
            pieces = [
                None if ids is None else own.decode_pieces(np.asarray([-1 if i is None else i for i in ids], np.int64))
                for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "text": pa.array([None if p is None else "".join(p) for p in pieces], pa.string()),
                "pieces": pa.array(pieces, pa.list_(pa.string())),
            })

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string, pieces array<string>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, and both hashed.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` of the decoded bytes.
    Odd input is taken as by ``encode``; nothing is written in between, as both are one pass over a row.
    """
    description = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(description.value, pattern)
        for batch in slices(batches, 64):
            counts, hashes, decoded = [], [], []
            for ids in own.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode_bytes(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(hashes, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            })

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
