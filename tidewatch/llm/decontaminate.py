"""Passages of benchmark items in documents: word pairs that no passage can do without, then local alignment.

An item is in a document in either of two ways. The words are aligned locally (Smith-Waterman):

* as a whole: a match counts 2, a mismatch or gap -1, and the best stretch reaches ``threshold`` of what the whole
  item would have. Copies that were edited or shortened keep most of it.
* in part: a match counts 1, a mismatch or gap -``EDIT``, and the best stretch reaches ``PASSAGE``. So ``PASSAGE``
  words in a row are enough, and more words if some are edited, however long the item is.

What is aligned is found without loss:

1. In a stretch that reaches the threshold, a word of the item and its next matched one are mostly at most two words
   apart, in the item and in the document: if more than ``least_links`` allows were further apart, the edits
   between them would cost too much. So that many of the item's positions have a pair of words, one or two
   apart, that the document has one or two apart as well.
2. Half of these must be met even if the positions with the most common pairs are left out, as many as the other
   half. A document is looked at where it has so many pairs within the longest stretch that can reach the threshold.
   How common a pair is, is counted in all documents; it makes the search faster and changes no result.
3. A stretch that reaches ``PASSAGE`` has at least ``PASSAGE`` - 3 runs of ``GRAM`` words without an edit. All such
   runs of an item are looked up. It matters only for items longer than 2 * ``PASSAGE`` words: in shorter ones
   such a stretch reaches the threshold of one half.

Items of fewer than ``MIN_WORDS`` words are found where all their words stand in a row. Characters of scripts that
are written without spaces are words of their own.

Items are taken in blocks of bounded size, each of which is sent to all executors and met with all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import mix64, plain_words, slices, windows, word_hashes

#: Items of fewer words are found as they are only: an edited one is in any text.
MIN_WORDS = 5
THRESHOLD = 0.5
#: Words in a row that are a passage of an item, and words that make up for an edit.
PASSAGE = 13
EDIT = 3
#: Any stretch that reaches ``PASSAGE`` has ``PASSAGE`` - EDIT runs of so many words.
GRAM = EDIT + 1
#: Items in one block, and characters that a block's items have about.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
#: Words of documents that are looked at together.
SLICE_WORDS = 60_000
MATCH, MISMATCH, GAP = 2, -1, -1


def _any_of(*ranges: tuple[int, int]) -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


#: Signs of scripts without spaces, and their characters: Thai to Myanmar, Khmer, Chinese and Japanese.
_SIGN = _any_of((0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_ALONE = _any_of((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x31F0, 0x31FF),
                 (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def split_words(text: str) -> list[bytes]:
    """Plain words; characters of scripts without spaces are words, and their signs separate."""
    if not text.isascii() and _ALONE.search(text):
        text = _ALONE.sub(r" \g<0> ", _SIGN.sub(" ", text))
    return plain_words(text)


def plain_hashes(text: str) -> np.ndarray:
    return word_hashes.of(split_words(text))


def _table(item: np.ndarray, window: np.ndarray, match: int = MATCH, edit: int = -GAP) -> tuple[int, int, int]:
    """Score of the best local alignment and its last positions in item and window (first such)."""
    slope = np.arange(len(window) + 1, dtype=np.int64) * edit
    above = np.zeros(len(window) + 1, np.int64)
    best, end = 0, (0, 0)
    for i, word in enumerate(item):
        step = np.where(window == word, match, -edit)
        now = np.zeros_like(above)
        now[1:] = np.maximum(above[:-1] + step, above[1:] - edit)
        np.maximum(now, 0, out=now)
        above = np.maximum.accumulate(now + slope) - slope
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), (i, j - 1)
    return best, *end


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Score from 0 to 1 and where the best alignment starts and ends (exclusive) in ``window``."""
    best, i, j = _table(item, window)
    if not best:
        return 0.0, 0, 0
    back = _table(item[i::-1], window[j::-1])[2]
    return best / (MATCH * len(item)), j - back, j + 1


def passage(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Matched words less ``EDIT`` for each edit, of the best stretch, and where it starts and ends in ``window``."""
    best, i, j = _table(item, window, 1, EDIT)
    if not best:
        return 0, 0, 0
    back = _table(item[i::-1], window[j::-1], 1, EDIT)[2]
    return best, j - back, j + 1


def least_links(n: int, threshold: float) -> int:
    """Of a stretch that reaches the threshold, how many matched words have the next one at most two words on.

    With m matches, the edits between them cost 2m - 2 * threshold * n at most. Words more than two apart cost two
    or more, so at most m - threshold * n of the m - 1 steps are such.
    """
    return max(1, math.ceil(threshold * n - 1e-9) - 1)


def most_words(n: int, threshold: float) -> int:
    """Words of a document that a stretch which reaches the threshold has at most."""
    return n + max(0, math.floor(2 * n * (1 - threshold) + 1e-9))


def pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """A hash of each word and the one so many words on."""
    with np.errstate(over="ignore"):
        return mix64(mix64(words[:-apart]) + words[apart:])


class Lookup:
    """Hashes and, for each, the items that have it, once per item."""

    def __init__(self, grams: list[np.ndarray], items: list[int]):
        sizes = [len(x) for x in grams]
        both = np.rec.fromarrays([np.concatenate(grams) if grams else np.empty(0, np.uint64),
                                  np.repeat(np.asarray(items, np.int64), sizes)], names="gram,item")
        both = np.unique(both)
        self.grams, first = np.unique(both["gram"], return_index=True)
        self.starts = np.append(first, len(both)).astype(np.int64)
        self.items = np.ascontiguousarray(both["item"])
        self.bits = np.uint64((1 << max(16, len(self.grams).bit_length() + 5)) - 1)
        self.maybe = np.zeros(int(self.bits) + 1, bool)
        self.maybe[self.grams & self.bits] = True

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``found`` of hashes that are here, and where in ``grams`` these are."""
        if not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.maybe[found & self.bits])
        place = np.searchsorted(self.grams, found[at])
        place[place == len(self.grams)] = 0
        same = self.grams[place] == found[at]
        return at[same], place[same]

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``found`` and items that have the hash there."""
        at, place = self.places(found)
        n = self.starts[place + 1] - self.starts[place]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.items[np.repeat(self.starts[place], n) + within]


def _joined(texts: list[np.ndarray]) -> np.ndarray:
    """The words of all texts in a row; two words that no item has keep the texts apart."""
    apart = np.zeros(2, np.uint64)
    return np.concatenate([x for text in texts for x in (text, apart)])


def _some_at_a_time(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """The words of each text, of so many texts together that they have some ``SLICE_WORDS`` words."""
    some, held = [], 0
    for text in texts:
        some.append(plain_hashes(text or ""))
        held += len(some[-1])
        if held >= SLICE_WORDS:
            yield some
            some, held = [], 0
    if some:
        yield some


def _regions(at: np.ndarray, item: np.ndarray, text: np.ndarray, need: np.ndarray, most: np.ndarray):
    """text, item, start and end of stretches in which ``need[item]`` hits stand within ``most[item]`` words."""
    if not len(at):
        return
    code = text * len(need) + item
    order = np.lexsort((at, code))
    code, at = code[order], at[order]
    new = np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]))
    code, at = code[new], at[new]
    item = code % len(need)
    last = np.arange(len(at)) + need[item] - 1
    inside = np.flatnonzero(last < len(at))
    last = last[inside]
    good = (code[last] == code[inside]) & (at[last] - at[inside] < most[item[inside]])
    inside, last = inside[good], last[good]
    now = None
    for c, k, a, b in zip(code[inside].tolist(), item[inside].tolist(), at[last].tolist(), at[inside].tolist()):
        a, b = a + 2 - int(most[k]), b + int(most[k])
        if now and now[0] == c and a <= now[3]:
            now[2], now[3] = min(now[2], a), max(now[3], b)
            continue
        if now:
            yield now[0] // len(need), now[1], now[2], now[3]
        now = [c, k, a, b]
    if now:
        yield now[0] // len(need), now[1], now[2], now[3]


@dataclass
class Block:
    """Items' words and what is looked up: word pairs, runs of ``GRAM`` words, and whole items of few words."""

    items: list[np.ndarray]
    threshold: float
    links: np.ndarray
    need: np.ndarray
    most: np.ndarray
    passages: np.ndarray
    most_passage: np.ndarray
    seeds: Lookup
    grams: Lookup
    short: dict[int, Lookup]

    @classmethod
    def of(cls, items: list[np.ndarray], unspaced: list[bool], common: dict[int, int], threshold: float) -> Block:
        """``common``: how often the items' pairs were seen; ``unspaced``: where words are mostly characters."""
        size = np.asarray([len(words) for words in items], np.int64)
        links = np.asarray([least_links(n, threshold) for n in size.tolist()], np.int64)
        need = (links + 1) // 2
        seeds, grams, short = ([], []), ([], []), {}
        for k, words in enumerate(items):
            if len(words) < MIN_WORDS:
                own = short.setdefault(len(words), ([], []))
                own[0].append(windows(words, len(words)))
                own[1].append(k)
                continue
            near, far = pairs(words, 1), pairs(words, 2)
            seen = np.asarray([common.get(g, 0) for g in near.tolist()])
            seen[:-1] += np.asarray([common.get(g, 0) for g in far.tolist()])
            # of len(near) positions links[k] are met, so need[k] of those that stay when the others are left out
            keep = np.sort(np.argsort(seen, kind="stable")[:len(near) - links[k] + need[k]])
            seeds[0].append(np.concatenate([near[keep], far[keep[keep < len(far)]]]))
            seeds[1].append(k)
            if len(words) > 2 * PASSAGE or threshold > 0.5:
                grams[0].append(windows(words, GRAM))
                grams[1].append(k)
        passages = np.where(np.asarray(unspaced, bool), 2 * PASSAGE, PASSAGE)
        return cls(items, threshold, links, need,
                   np.asarray([most_words(n, threshold) for n in size.tolist()], np.int64),
                   passages, size + size // EDIT, Lookup(*seeds), Lookup(*grams),
                   {n: Lookup(*own) for n, own in sorted(short.items())})

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item, score, first word, end) of the best stretch of each item that is in it."""
        words = _joined(texts)
        size = np.asarray([len(text) for text in texts], np.int64)
        starts = np.cumsum(size + 2) - size - 2
        owner = lambda at: np.searchsorted(starts, at, "right") - 1
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]

        def keep(t: int, k: int, score: float, a: int, b: int) -> None:
            old = found[t].get(k)
            if old is None or (score, -a) > (old[0], -old[1]):
                found[t][k] = score, a, b

        for n, lookup in self.short.items():
            at, item = lookup.hits(windows(words, n))
            for t, k, a in zip(owner(at).tolist(), item.tolist(), (at - starts[owner(at)]).tolist()):
                keep(t, k, 1.0, a, a + n)
        near, far = (self.seeds.hits(pairs(words, apart)) for apart in (1, 2))
        at, item = np.append(near[0], far[0]), np.append(near[1], far[1])
        for t, k, a, b in _regions(at, item, owner(at), self.need, self.most):
            a, b = max(0, a - int(starts[t])), min(len(texts[t]), b - int(starts[t]))
            score, start, end = self._aligned(k, texts[t][a:b])
            if score >= self.threshold:
                keep(t, k, score, a + start, a + end)
        at, item = self.grams.hits(windows(words, GRAM))
        for t, k, a, b in _regions(at, item, owner(at), self.passages - EDIT, self.most_passage):
            if k in found[t] and found[t][k][0] >= self.threshold:
                continue
            a, b = max(0, a - int(starts[t])), min(len(texts[t]), b - int(starts[t]))
            length, start, end = passage(self.items[k], texts[t][a:b])
            if length >= self.passages[k]:
                start, end = a + start, a + end
                keep(t, k, align(self.items[k], texts[t][start:end])[0], start, end)
        return [[(k, *x) for k, x in sorted(own.items())] for own in found]

    def _aligned(self, item: int, window: np.ndarray) -> tuple[float, int, int]:
        words = self.items[item]
        have = np.concatenate([pairs(window, 1), pairs(window, 2)])
        met = np.isin(pairs(words, 1), have)
        met[:-1] |= np.isin(pairs(words, 2), have)
        if np.count_nonzero(met) < self.links[item]:
            return 0.0, 0, 0
        bag = Counter(window.tolist())
        shared = sum(min(n, bag[w]) for w, n in Counter(words.tolist()).items())
        if shared < self.threshold * len(words):
            return 0.0, 0, 0
        return align(words, window)


def _counted(docs: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """How often each of ``grams`` (sorted) occurs in the documents; as many rows as grams reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Lookup([grams], [0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        hits = np.zeros(len(own.grams), np.int64)
        for some in _some_at_a_time(text for batch in slices(batches) for text in batch.column(0).to_pylist()):
            words = _joined(some)
            for apart in (1, 2):
                np.add.at(hits, own.places(pairs(words, apart))[1], 1)
        met = np.flatnonzero(hits)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(met, pa.int64()), "n": pa.array(hits[met], pa.int64())})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(count, "gram long, n long")
    rows = found.groupBy("gram").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return {int(grams[r["gram"]]): r["n"] for r in rows}


def blocks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[tuple[Block, list[int]]]:
    """The benchmark's items in blocks, and the items' ids.

    Items with a null id or without words are left out; of equal ids every different text is an item.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-total["n"] // BLOCK_ITEMS), -(-(total["chars"] or 0) // BLOCK_CHARS))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        items = [(r["item_id"], r["text"], plain_hashes(r["text"])) for r in own]
        items = [x for x in items if len(x[2])]
        if not items:
            continue
        words = [x[2] for x in items]
        grams = [pairs(x, apart) for x in words for apart in (1, 2)]
        common = _counted(docs, np.unique(np.concatenate(grams)))
        unspaced = [2 * len(_ALONE.findall(text)) > len(x) for _, text, x in items]
        yield Block.of(words, unspaced, common, threshold), [i for i, _, _ in items]


LEAKS = "array<struct<item_id: long, score: double, start_word: int, end_word: int>>"


def _finder(shared):
    @F.pandas_udf(LEAKS)
    def find(text: pd.Series) -> pd.Series:
        own, names = shared.value
        rows = [[{"item_id": names[k], "score": s, "start_word": a, "end_word": b} for k, s, a, b in x]
                for some in _some_at_a_time(text.fillna("")) for x in own.find(some)]
        return pd.Series(rows, dtype=object)

    return find


def leaks_column(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> Column:
    """For the text of ``docs``: the benchmark items in it, with score and the words they span."""
    context = docs.sparkSession.sparkContext
    columns = [_finder(context.broadcast(block))(F.col("text").cast("string"))
               for block in blocks(docs, benchmark, threshold)]
    if not columns:
        return F.array().cast(LEAKS)
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_word and end_word of each item found in each document.

    The score is that of the words spanned as a copy of the whole item; it is below the threshold where they are a
    passage of a longer one. Words are lower-cased and without ASCII punctuation. A null or empty text has no item in it, nor has an
    item without text; texts of any length are searched whole; repeated rows each give their own; an item id
    with several texts gives a row for each that is found; no rows give none. Only ``doc_id``, ``item_id`` and ``text``
    are read.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks_column(docs, benchmark, threshold)).alias("x"))
    return found.select("doc_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns."""
    return docs.where(F.size(leaks_column(docs, benchmark, threshold)) == 0)
