"""Toxicity by the nearest labelled examples.

Texts are vectors of TF-IDF weights, (1 + ln tf) * idf, of length one, and are compared by cosine with all examples.
There are two searches, both exact.

* *Whole vectors.* All words count. Every example with a cosine of ``NEAR`` or more is found. The postings of the
  text's words are added up from the rarest word on, until what is left of the text is shorter than a share of ``NEAR``.
  What is left can add no more than its length, so only examples whose sum comes near enough are compared in
  full. A copy of a labelled text thus has a neighbour of cosine one, whatever its words.
* *Telling words.* Most words say nothing about the label, and in prose they make up most of a vector. So the
  words whose presence depends on the label among the examples (chi-square above ``MIN_CHI2``, and at least
  ``MIN_RATIO`` times as frequent under one label) are vectors of their own. The nearest ``K`` by these, and all that tie
  with the last, are found however far they are.

All neighbours vote, weighted by similarity, those of the first search ``NEAR_WEIGHT`` times. The vote is shrunk towards
the share of toxic examples that have no telling word, which is also the score of a text without neighbours.

The examples are kept as an inverted index in blocks: examples are ordered so that similar ones are
neighbours, cut into blocks, and each word has its largest weight in each block. The sum of a text's weights
times these is the most that any example of the block can reach. Blocks are visited from the largest of these
bounds downwards until the bound falls below the K-th best similarity, so the result is exact. The index is
learned from a bounded sample (``MAX_EXAMPLES`` of each label) and is sent to all executors.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_examples, held_out, plain_words, slices, word_hashes
from tidewatch.llm.ranking import learnable
from tidewatch.session import staged

#: At most so many labelled documents of each label are learned from, those of lowest hashed id.
MAX_EXAMPLES = 4_000
#: Nearest examples that vote.
K = 15
#: Weight of the share without neighbours in a vote.
PRIOR_WEIGHT = 0.5
#: Chi-square (one degree of freedom) that a word needs; about one in ten million words has it by chance.
MIN_CHI2 = 28.4
#: A word must be so many times as frequent under one label as under the other: one that is merely a little
#: more frequent can be significant too, and says nothing.
MIN_RATIO = 2.0
#: Examples that a word must be in.
MIN_EXAMPLES = 5
BLOCK = 64
#: Cosine of whole vectors from which on an example is a neighbour, and how many times its vote counts.
NEAR, NEAR_WEIGHT = 0.8, 4.0
#: Share of ``NEAR`` that the unread rest of a text may have; only speed depends on it.
UNREAD = 0.6


def hashed_counts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a text as ascending 64-bit hashes, and how often each occurs."""
    return np.unique(word_hashes.of(words), return_counts=True)


class WholeIndex:
    """Whole vectors of examples: postings of words, and each example's words with weights.

    ``examples`` are (id, label, hashes, counts) as from ``hashed_counts``; ``weights`` those of a vote for label 0 and 1.
    Words are numbered by frequency, so that the rarest come first.
    """

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: tuple[float, float] = (1.0, 1.0)):
        n = len(examples)
        self.ids = [e[0] for e in examples]
        self.toxic = np.array([e[1] for e in examples], bool)
        self.votes = np.array([weights[e[1]] for e in examples])
        self.hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *[e[2] for e in examples]]))
        ends = np.cumsum([0, *[len(e[2]) for e in examples]])
        # one flat array each, as there are some millions of entries
        self.ends, self.words, self.counts = ends, np.empty(ends[-1], np.int32), np.empty(ends[-1], np.uint32)
        for e, a, b in zip(examples, ends, ends[1:]):
            self.words[a:b], self.counts[a:b] = np.searchsorted(self.hashes, e[2]), e[3]
        frequency = np.bincount(self.words, minlength=len(self.hashes))
        order = np.argsort(frequency, kind="stable")
        self.number = np.empty(len(order), np.int32)  # of the word at each place of ``hashes``
        self.number[order] = np.arange(len(order), dtype=np.int32)
        self.idf = np.log((1 + n) / (1 + frequency[order])) + 1
        self.unknown = math.log(1 + n) + 1  # of words that no example has
        values = np.empty(ends[-1], np.float32)
        for a, b in zip(ends, ends[1:]):
            own = np.argsort(words := self.number[self.words[a:b]])
            self.words[a:b], self.counts[a:b] = words[own], self.counts[a:b][own]
            values[a:b] = self._unit(self.words[a:b], self.counts[a:b])[1]
        place = np.argsort(self.words, kind="stable").astype(np.int32)
        self.owners = (np.searchsorted(ends, place, side="right") - 1).astype(np.int32)
        self.values = values[place]
        self.starts = np.searchsorted(self.words[place], np.arange(len(order) + 1))

    def _unit(self, words: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Words in ascending order with weights; ``rest`` is the square of the length that other words add."""
        order = np.argsort(words)
        words, weights = words[order], (1 + np.log(counts[order])) * self.idf[words[order]]
        length = math.sqrt(float(weights @ weights) + rest)
        return words, weights / length if length else weights

    def near(self, hashes: np.ndarray, counts: np.ndarray, least: float = NEAR) -> list[tuple[float, int]]:
        """(cosine, example) of all examples with a cosine of ``least`` or more, the largest first."""
        if not len(self.hashes):
            return []
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        rest = float(((1 + np.log(counts[~known])) ** 2).sum()) * self.unknown**2
        words, weights = self._unit(self.number[at[known]], counts[known], rest)
        left = np.cumsum((weights * weights)[::-1])[::-1]  # squared, from this word on
        if not len(words) or left[0] < least * least - 1e-9:
            return []
        read = int(np.searchsorted(-left, -((UNREAD * least) ** 2), side="right"))
        rest = math.sqrt(left[read]) if read < len(words) else 0.0
        starts = self.starts[words[:read]]
        sizes = self.starts[words[:read] + 1] - starts
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        sums = np.bincount(self.owners[at], self.values[at] * np.repeat(weights[:read], sizes), len(self.ids))
        found = []
        for example in np.flatnonzero(sums >= least - rest - 1e-5).tolist():  # sums are of 32-bit values
            a, b = self.ends[example], self.ends[example + 1]
            theirs, values = self._unit(self.words[a:b], self.counts[a:b])
            at = np.minimum(np.searchsorted(theirs, words), len(theirs) - 1)
            both = theirs[at] == words
            cosine = float(weights[both] @ values[at[both]])
            if cosine >= least - 1e-9:
                found.append((round(cosine, 12), example))
        return sorted(found, key=lambda x: (-x[0], self.ids[x[1]]))


@dataclass
class Index:
    """Examples with equal vectors are one entry with the weights of their labels.

    ``postings[word]``: entries (ascending) and weights; ``starts``: where each block's postings begin;
    ``tops``: the largest weight per block.
    """

    idf: dict[bytes, float]
    toxic: np.ndarray
    total: np.ndarray
    ids: list[list[int]]
    base: float
    postings: dict[bytes, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    starts: dict[bytes, np.ndarray] = field(default_factory=dict)
    tops: dict[bytes, np.ndarray] = field(default_factory=dict)
    whole: WholeIndex | None = None

    def vector(self, counts: Counter) -> dict[bytes, float]:
        raw = {w: (1 + math.log(n)) * self.idf[w] for w, n in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    def nearest(self, vector: dict[bytes, float], k: int = K) -> list[tuple[float, int]]:
        """(similarity, entry) of the k nearest with a similarity above zero, and all that tie with the last."""
        blocks = -(-len(self.total) // BLOCK)
        bound = np.zeros(blocks)
        for word, weight in vector.items():
            bound += weight * self.tops[word]
        best: list[tuple[float, int]] = []
        least = 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or bound[block] < least - 1e-9:
                break
            found = np.zeros(BLOCK)
            for word, weight in vector.items():
                a, b = self.starts[word][block], self.starts[word][block + 1]
                entries, weights = self.postings[word]
                found[entries[a:b] - block * BLOCK] += weight * weights[a:b]
            best += [(round(float(found[j]), 12), block * BLOCK + j) for j in np.flatnonzero(found).tolist()]
            best = self._cut(best, k)
            if sum(self.total[e] >= 0 for _, e in best) >= k:
                least = best[-1][0]
        return best

    @staticmethod
    def _cut(best: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
        best.sort(key=lambda x: (-x[0], x[1]))
        if len(best) <= k:
            return best
        last = best[k - 1][0]
        return [x for x in best if x[0] >= last]

    def score(self, words: list[bytes]) -> tuple[float, list[int], list[str]]:
        """Score, ids of some nearest examples, and the telling words that brought them."""
        vector = self.vector(Counter([w for w in words if w in self.idf]))
        near = self.nearest(vector) if vector and len(self.total) else []
        votes = sum(s * self.toxic[e] for s, e in near)
        weight = sum(s * self.total[e] for s, e in near)
        evidence = [i for _, e in near[:3] for i in self.ids[e][:1]]
        if self.whole is not None:
            copies = self.whole.near(*hashed_counts(words))
            shares = [(NEAR_WEIGHT * s * self.whole.votes[e], self.whole.toxic[e]) for s, e in copies]
            votes += sum(x for x, toxic in shares if toxic)
            weight += sum(x for x, _ in shares)
            evidence = list(dict.fromkeys([self.whole.ids[e] for _, e in copies[:3]] + evidence))[:3]
        score = (votes + PRIOR_WEIGHT * self.base) / (weight + PRIOR_WEIGHT)
        terms = [w.decode("utf-8", "replace") for w in sorted(vector, key=vector.get)[::-1][:5]]
        return float(score), evidence, terms


def build_index(examples: list[tuple[int, int, dict[bytes, int]]], vocabulary: set[bytes],
                weights: tuple[float, float] = (1.0, 1.0)) -> Index:
    """An index of (id, label, word counts) by telling words; ``weights`` are those of one example of label 0 and 1."""
    n = len(examples)
    df = Counter(w for _, _, counts in examples for w in counts if w in vocabulary)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocabulary}
    index = Index(idf, np.empty(0), np.empty(0), [], 0.0)
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, label, counts in examples:
        key = tuple(sorted((w, c) for w, c in counts.items() if w in vocabulary))
        groups.setdefault(key, []).append((i, label))
    without = groups.pop((), [])
    mass = sum(weights[y] for _, y in without)
    index.base = sum(weights[1] for _, y in without if y) / mass if mass else 0.5
    # the rarest word first, so that examples that share it are neighbours
    keys = sorted(groups, key=lambda key: sorted(((-idf[w], w) for w, _ in key)))
    index.toxic = np.asarray([sum(weights[1] for _, y in groups[k] if y) for k in keys])
    index.total = np.asarray([sum(weights[y] for _, y in groups[k]) for k in keys])
    index.ids = [sorted(i for i, _ in groups[k]) for k in keys]
    lists: dict[bytes, list[tuple[int, float]]] = {w: [] for w in vocabulary}
    for e, key in enumerate(keys):
        for w, x in index.vector(Counter(dict(key))).items():
            lists[w].append((e, x))
    blocks = -(-len(keys) // BLOCK)
    for w, entries in lists.items():
        ids = np.asarray([e for e, _ in entries], np.int64)
        weight = np.asarray([x for _, x in entries])
        starts = np.searchsorted(ids, np.arange(blocks + 1) * BLOCK)
        tops = np.zeros(blocks)
        np.maximum.at(tops, ids // BLOCK, weight)
        index.postings[w], index.starts[w], index.tops[w] = (ids, weight), starts, tops
    return index


def _word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, label, the distinct words of each text, with counts, and the same as hashes in binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in slices(batches, 64):
            texts = [plain_words(t or "") for t in batch.column(2).to_pylist()]
            rows = [[{"word": w, "n": n} for w, n in Counter(words).items()] for words in texts]
            hashes = [hashed_counts(words) for words in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, kind), pa.array([h.tobytes() for h, _ in hashes], pa.binary()),
                 pa.array([n.astype("<u4").tobytes() for _, n in hashes], pa.binary())],
                ["doc_id", "label", "words", "hashes", "counts"])

    return docs.select("doc_id", "label", "text").mapInArrow(
        count, "doc_id long, label int, words array<struct<word: binary, n: long>>, hashes binary, counts binary")


def fit_index(docs: DataFrame, examples: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """Learn from the texts of ``examples`` (doc_id, label 0 or 1).

    Uses at most ``max_examples`` of each label, those of lowest hashed id, and one of those whose words
    and their counts are equal; a label's weight in a vote makes up for those left out. Without examples every score is one half.
    """
    marked = examples.where(F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = staged(bounded_examples(marked, max_examples))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * max_examples ids go to all executors, so that texts stay where they are
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    copies = Window.partitionBy("label", F.sha2(F.concat("hashes", "counts"), 256)).orderBy("doc_id")
    found = staged(_word_counts(texts).withColumn("copy", F.row_number().over(copies)).where("copy = 1"))
    sizes = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 + n1:
        return build_index([], set())
    present = found.select("label", F.explode("words.word").alias("word")).groupBy("word").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("b"), F.count("*").alias("m"))
    a, b, m, n = F.col("m") - F.col("b"), F.col("b"), F.col("m"), n0 + n1
    # the 2 x 2 table of label and presence
    chi2 = n * F.pow(a * (n1 - b) - b * (n0 - a), F.lit(2)) / (m * (n - m) * F.lit(float(max(1, n0)) * max(1, n1)))
    spread = (m < n) & (m >= MIN_EXAMPLES)
    ratio = ((b + 0.5) * (n0 + 1)) / ((a + 0.5) * (n1 + 1))
    telling = (chi2 >= MIN_CHI2) & ((ratio >= MIN_RATIO) | (ratio <= 1 / MIN_RATIO))
    vocabulary = {bytes(r["word"]) for r in present.where(spread & telling).collect()}
    keep = F.array(*[F.lit(w) for w in sorted(vocabulary)]) if vocabulary else F.array().cast("array<binary>")
    told = F.filter("words", lambda x: F.array_contains(keep, x["word"])).alias("words")
    own = found.select("doc_id", "label", told, "hashes", "counts").orderBy("doc_id").collect()
    weights = (counts.get(0, 0) / max(1, n0), counts.get(1, 0) / max(1, n1))
    index = build_index(
        [(r["doc_id"], r["label"], {bytes(x["word"]): x["n"] for x in r["words"]}) for r in own], vocabulary, weights)
    blobs = [(r["doc_id"], r["label"], np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], "<u4")) for r in own]
    del own
    index.whole = WholeIndex(blobs, weights)
    return index


def toxicity_scores(docs: DataFrame, labels: DataFrame, column: str = "toxic", cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest (ids of examples) and terms of every document.

    Labels are learned only from rows that are not held out. Scores depend on the text alone; a null or empty
    text has no neighbours; a null id is never held out nor
    learned from; repeated rows are all scored; no rows give none. Other columns are not read.
    """
    index = fit_index(docs, learnable(labels, column))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index  # workers have it

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        for batch in slices(batches):
            rows = [own.score(plain_words(text or "")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.float64()),
                 pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                ["doc_id", "score", "nearest", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(judge, "doc_id long, score double, nearest array<long>, terms array<string>")
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= cut).cast("int").alias("predicted"), "nearest", "terms")
