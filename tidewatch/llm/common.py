"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import staged

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without an argument splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"

#: Rows and bytes that Spark sends to a Python worker at a time, see ``small_batches``.
BATCH_ROWS, BATCH_BYTES = 2_000, "4m"

#: Rows that a Python worker takes from an Arrow batch at a time.
SLICE = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let this session send whole texts to Python in smaller batches: a batch stands in the JVM and in the worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, longer if need be, so that it is none of ``columns`` (upper and lower case are the same)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_of_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes in a column of texts: at most that and one text."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(length, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def without_cache(tokenizer):
    """A tokenizer whose model remembers no words: for callers that ask for each word once, that is half of the time."""
    resize = getattr(tokenizer.model, "_resize_cache", None)
    if resize is not None:
        resize(0)
    return tokenizer


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null gives empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


#: Everything but ASCII letters, digits and bytes of other characters separates plain words.
_SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for documents that no label may be learned from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str)
                              else doc_id.cast("string")) % 3 == 1, F.lit(False))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that scatters them (splitmix64's last steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the next text; emptied when there are too many."""

    def __init__(self, hash_function: Callable[[bytes], int], limit: int = 100_000):
        super().__init__()
        self.hash_function, self.limit = hash_function, limit

    def __missing__(self, word: bytes) -> int:
        value = self.hash_function(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per Python worker, for all operators: workers are used again, and each such table takes some 17 MB.
word_hashes = WordHashes(xxhash.xxh3_64_intdigest)


def release_memory() -> None:
    """Give back what this Python worker holds but does not need: remembered words, and free blocks of Arrow and C."""
    word_hashes.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` hashes, in order; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0]
    out = hashes[:count].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix64(out) + hashes[k:count + k]
    return mix64(out)


def bounded_examples(examples: DataFrame, most: int) -> DataFrame:
    """Of ``examples`` (doc_id, label) at most ``most`` of label 0 and of label 1: those of lowest hashed id."""
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = [examples.where(F.col("label") == y).orderBy(*order).limit(most) for y in (0, 1)]
    return parts[0].union(parts[1])


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows``, written out, with their number from 0 in the given order: the place in a range and the sizes of those before."""
    place = free_name([*rows.columns, name], "place")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ranged.withColumn(place, F.monotonically_increasing_id()))
    # the id has the partition in its upper bits and the row's place there in the lower 33
    part, start = free_name(found.columns, "part"), free_name([*found.columns, name], "start")
    found = found.withColumn(part, F.shiftright(place, 33))
    bases, total = [], 0
    for r in sorted(found.groupBy(part).count().collect()):  # a row per task
        bases.append((r[0], total))
        total += r[1]
    starts = rows.sparkSession.createDataFrame(bases, f"`{part}` long, `{start}` long")
    number = F.col(start) + F.col(place).bitwiseAND((1 << 33) - 1)
    return found.join(starts, part).withColumn(name, number).drop(part, place, start)
