"""Token ids as flat binary files with 64-bit document offsets.

A dataset is one folder:

* ``part-NNNNN.bin``: unsigned integers, little-endian, one after another; 16 bits wide if the
  vocabulary has at most 65,536 ids and 32 bits wide otherwise;
* ``part-NNNNN.idx``: unsigned 64-bit integers, one more than there are documents in the part: where
  each document starts, counted in ids from the start of the *dataset*, and the end of the last one;
* ``part-NNNNN.doc``: the documents' ids as signed 64-bit integers (the lowest one stands for null);
* ``manifest.json``: width, parts, documents and ids in each part and before it.

Documents are in ascending order of id over all parts (nulls first, equal ids by text). Parts are
encoded and written by separate tasks, which can't know what stands before them. So lengths are
summed up per part first (one row per part reaches the driver), and a second job adds each part's
base, the sum over the parts before it, to its offsets. All files are written under another name
and then renamed, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import release_memory, slices_of_bytes, without_cache
from tidewatch.session import scratch

NULL_ID = -(1 << 63)

#: One word of Latin-1 letters and the ASCII signs after it. The tokenizer always cuts between
#: letters and these signs and ignores case, so both parts can be encoded on their own.
_PLAIN = re.compile(r"(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]{1,40})(?P<sign>[.,;:!?|#$%&*]{0,8})")


#: Words that a worker remembers in the newer half; as many other chunks as a quarter of that.
REMEMBERED = 600_000

#: Bytes of text that a worker encodes at a time, for each word that it remembers.
BYTES_PER_WORD = 12


class Encoder:
    """Encodes texts word by word, remembering words.

    The result equals ``Tokenizer.encode`` of the whole text for tokenizers that drop white space and
    never join what it separates; ``word_at_a_time`` says whether a tokenizer is one. Others
    encode whole texts. Arrow finds the different chunks of all texts given at once, then the different words in
    them; only these become Python objects, and only unknown ones go to the tokenizer. What is remembered
    has a bound: when the newer half is full, the older half goes.
    """

    def __init__(self, path: str, limit: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.word_at_a_time = self._word_at_a_time()
        if self.word_at_a_time:  # for words that are one piece each and need no normalizing
            self.model = without_cache(Tokenizer.from_str(self.tokenizer.to_str())).model
            pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.characters = {k: pieces.pre_tokenize_str(chr(k))[0][0] for k in range(0xDF, 0x100)}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def _word_at_a_time(self) -> bool:
        spec = json.loads(self.tokenizer.to_str())
        rules = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        splits = [r for r in rules if r["type"] == "Split"]
        drops = bool(splits) and splits[0]["behavior"] == "Removed" and (
            r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in splits[0]["pattern"].get("Regex", ""))
        lowers = "Lowercase" in str(spec["normalizer"])
        return drops and lowers and spec["post_processor"] is None

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of lower-cased words of Latin-1 letters, which are one piece each for the tokenizer."""
        tokenize, characters = self.model.tokenize, self.characters
        found = [tokenize(word if word.isascii() else word.translate(characters)) for word in words]
        data = np.fromiter((token.id for tokens in found for token in tokens), self.dtype).tobytes()
        ends = list(accumulate(len(tokens) * self.dtype.itemsize for tokens in found))
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _remembered(keys: list[str], known: dict[str, bytes], older: dict[str, bytes], find) -> list[bytes]:
        """The ids of different ``keys``; those that neither half knows are found, and all are in the newer half then."""
        missing = [key for key in keys if key not in known]
        known.update((key, older[key]) for key in missing if key in older)
        missing = [key for key in missing if key not in known]
        known.update(zip(missing, find(missing)))
        return [known[key] for key in keys]

    def _chunk_ids(self, chunks: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
        """The ids of different chunks in an order of its own, and the place of each chunk there."""
        found = pc.extract_regex(chunks, f"^{_PLAIN.pattern}$")
        is_plain = found.is_valid()
        plain = found.filter(is_plain)
        words = pc.utf8_lower(pc.struct_field(plain, "word")).dictionary_encode()
        signs = pc.struct_field(plain, "sign").dictionary_encode()
        of_words = self._remembered(words.dictionary.to_pylist(), self.words, self.older_words, self.word_ids)
        of_signs = self._remembered(signs.dictionary.to_pylist(), self.signs, {}, lambda x: list(map(self._ids, x)))
        others = chunks.filter(pc.invert(is_plain)).to_pylist()
        of_others = self._remembered(others, self.chunks, self.older_chunks, lambda x: list(map(self._ids, x)))
        for chunk in others:
            if len(chunk) > 64:
                del self.chunks[chunk]
        kind = pa.large_binary()
        joined = pc.binary_join_element_wise(
            pa.array(of_words, kind).take(words.indices), pa.array(of_signs, kind).take(signs.indices), pa.scalar(b"", kind))
        mask = is_plain.to_numpy(zero_copy_only=False)
        places = np.where(mask, np.cumsum(mask) - 1, len(joined) + np.cumsum(~mask) - 1)
        return pa.concat_arrays([joined, pa.array(of_others, kind)]), places

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not self.word_at_a_time:
            return [self._ids(text) for text in (texts if isinstance(texts, list) else texts.to_pylist())]
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        ids, places = self._chunk_ids(chunks.dictionary)
        flat = ids.take(pa.array(places[chunks.indices.to_numpy()]))
        at = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy())])[at].tolist()
        data = flat.buffers()[2]
        data = memoryview(data) if data is not None else b""
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        if len(self.chunks) > self.limit // 4:
            self.chunks, self.older_chunks = {}, self.chunks
        if len(self.words) > self.limit:
            self.words, self.older_words = {}, self.words
        if len(self.signs) > self.limit // 4:
            self.signs.clear()
        return out


@cache
def encoder(path: str, limit: int = REMEMBERED) -> Encoder:
    """One encoder per Python worker, which first gives back what it holds for other operators."""
    release_memory()
    return Encoder(path, limit)


def resolved(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: without one it is on Spark's default file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a ``resolved`` folder."""
    if ":/" not in folder:
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path, self.draft = store, path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.stream = self.store.open_output_stream(self.draft)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.store.move(self.draft, self.path)
        else:
            self.store.delete_file(self.draft)


def _write_parts(folder: str, path: str, end_id: int | None, remembered: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, remembered)
        end = b"" if end_id is None else np.asarray([end_id], encode.dtype).tobytes()
        width, part = encode.dtype.itemsize, TaskContext.get().partitionId()
        store, root = _open(folder)
        ids, lengths = [], []
        pieces = slices_of_bytes(batches, 1, BYTES_PER_WORD * remembered)
        first = next(pieces, None)
        if first is None:
            return
        with _File(store, f"{root}/part-{part:05d}.bin") as out:
            while first is not None:
                for data in encode.encode(first.column(1).fill_null("")):
                    out.write(data)
                    out.write(end)
                    lengths.append((len(data) + len(end)) // width)
                ids.append(first.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                first = next(pieces, None)
        with _File(store, f"{root}/part-{part:05d}.doc") as out:
            out.write(np.concatenate(ids).astype("<i8").tobytes())
        with _File(store, f"{root}/part-{part:05d}.len") as out:
            out.write(np.asarray(lengths, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "docs": [len(lengths)], "ids": [sum(lengths)]},
            pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return write


def _values(store: fs.FileSystem, path: str, dtype: str, start: int, stop: int) -> np.ndarray:
    """Values ``start`` to ``stop`` of a file; memory-mapped where the file system is local, else only these are read."""
    if stop <= start:
        return np.empty(0, dtype)
    width = np.dtype(dtype).itemsize
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r", start * width, stop - start)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_at((stop - start) * width, start * width), dtype)


def _write_offsets(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for part, base, docs in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{root}/part-{part:05d}"
                lengths = _values(store, f"{name}.len", "<u8", 0, docs)
                offsets = np.concatenate([[base], base + np.cumsum(lengths)]).astype("<u8")
                with _File(store, f"{name}.idx") as out:
                    out.write(offsets.tobytes())
            yield batch

    return write


_PART = "part long, base long, docs long"


def _parts(spark: SparkSession, parts: list[tuple[int, int, int]]) -> DataFrame:
    """One row per part (number, base, documents), each in a partition of its own."""
    rows = spark.createDataFrame(parts, _PART)
    return rows.repartitionByRange(max(1, len(parts)), "part")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, remembered: int = REMEMBERED
) -> dict:
    """Encode ``docs`` (doc_id, text) and write them as a dataset; returns its manifest.

    ``tokenizer`` is the path of a file of the tokenizers library, which all executors have.
    ``end_id`` closes each document; None writes none. A null text is an empty one; a null id is
    kept and sorts first; equal ids are all kept, ordered by text; other columns are ignored. No
    rows give a manifest without parts. One document's ids are in memory at a time, besides a batch of texts.
    Fewer ``remembered`` words take less of a worker's memory and more time; the files are the same.
    """
    spark = docs.sparkSession
    folder = resolved(spark, folder)
    store, root = _open(folder)
    store.create_dir(root)
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (
        rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
        .mapInArrow(_write_parts(folder, tokenizer, end_id, remembered), "part long, docs long, ids long")
        .collect()
    )
    found.sort()
    bases = [0, *accumulate(r["ids"] for r in found)]
    if found:
        marked = _parts(spark, [(r["part"], base, r["docs"]) for r, base in zip(found, bases)])
        marked.mapInArrow(_write_offsets(folder), _PART).count()
    manifest = {
        "dtype": encoder(tokenizer, remembered).dtype.str,
        "end_id": end_id,
        "parts": [{"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": base}
                  for r, base in zip(found, bases)],
    }
    with _File(store, f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/manifest.json") as file:
        return json.loads(file.read())


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Documents of a dataset from its files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    folder = resolved(spark, folder)
    manifest = read_manifest(folder)
    dtype = manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for part, base, docs in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{root}/part-{part:05d}"
                for at in range(0, docs, 256):
                    own = np.asarray(_values(store, f"{name}.doc", "<i8", at, min(at + 256, docs)))
                    offsets = _values(store, f"{name}.idx", "<u8", at, at + len(own) + 1).astype(np.int64)
                    starts, ends, first = offsets[:-1], offsets[1:], int(offsets[0])
                    data = _values(store, f"{name}.bin", dtype, first - base, int(offsets[-1]) - base)
                    some = [data[a - first:b - first] for a, b in zip(starts, ends)]
                    columns = {
                        "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID),
                        "start": pa.array(starts),
                        "n_tokens": pa.array(ends - starts),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in some], pa.int64()),
                    }
                    if ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in some], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    return _parts(spark, [(p["part"], p["base"], p["docs"]) for p in manifest["parts"]]).mapInArrow(read, schema)


def tokens_of(docs: DataFrame, tokenizer: str, end_id: int | None = 1, remembered: int = REMEMBERED) -> DataFrame:
    """Write ``docs`` as a dataset in the shared folder and read it back; see ``read_tokens``."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_tokens(docs, folder, tokenizer, end_id, remembered)
    return read_tokens(spark, folder)
