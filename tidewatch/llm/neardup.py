"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on whole sets.

1. Each document becomes a set of hashed word shingles. Documents with equal sets are one class, and only
   the class's smallest id goes on, so thousands of exact copies cost one row.
2. ``BANDS * ROWS`` MinHash values are taken of each set. Sets that agree in all rows of a band meet in that
   band's bucket; at a similarity of 0.8 a pair meets in no bucket once in 310,000 times. The same values are
   folded into an odd sketch: each flips one of ``BITS`` bits. The bits in which two sketches differ give an
   estimate of similarity that is precise where similarity is high. At a similarity of 0.8 it rejects a pair that met
   once in ten million times, so that bands and sketches together miss one in 300,000.
3. In each bucket, members are compared with one of them (a star, one pair a row). Pairs whose sketches agree
   well enough are confirmed on their whole sets.
4. Buckets whose members are then all connected are done. In the others, members outside the largest component
   meet all members of other components, in blocks of bounded size, each pair in one bucket only. First each
   member's most similar candidate in a block is confirmed. Members that still have candidates then meet with
   their whole sets, and a block returns only links that connect components. So a group's pairs are
   looked at inside a task where need be, but never become rows.

Components are found by alternating star contraction over link tables. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name, mix64, slices, utf8, windows, word_hashes
from tidewatch.session import staged

BANDS, ROWS = 24, 4
BITS = 256
#: How far below the threshold a sketch's estimate may lie.
MARGIN = 0.3
#: Members of a bucket on either side of a block.
BLOCK = 512
#: A table of ids is sent to all executors up to this many rows (16 MB), and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20240101)
_A = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_SALT = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words, A-Z in lower case.

    Fewer words are one shingle; no words give none. ``bytes`` methods treat only ASCII letters and spaces.
    """
    words = text.lower().split()
    return np.unique(windows(word_hashes.of(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def minhashes(found: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that isn't empty."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(found), 1024):
            least = np.minimum(least, (_A[:, None] * found[None, start:start + 1024] + _B[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = _SALT[:BANDS].copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix64(key + rows[:, k])
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """``BITS`` parity bits as signed 64-bit integers."""
    with np.errstate(over="ignore"):
        at = mix64(least + _SALT) & np.uint64(BITS - 1)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def most_differing_bits(least_similarity: float) -> int:
    """Bits by which sketches of sets of this similarity differ, as expected."""
    differing = 2 * BANDS * ROWS * (1 - least_similarity)
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** differing)))


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the text's hash t, n_shingles, the set's hash (h, g), its bands and sketch; null where the set is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, h, g, bands, sketch = [], [], [], [], []
            for text in utf8(batch.column(1)):
                found = shingles(text, n)
                sizes.append(len(found))
                if not len(found):
                    for column in (h, g, bands, sketch):
                        column.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
                least = minhashes(found)
                h.append(int(digest[0]))
                g.append(int(digest[1]))
                bands.append(band_keys(least))
                sketch.append(odd_sketch(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()),
                 pa.array(bands, longs), pa.array(sketch, longs)],
                ["doc_id", "t", "n_shingles", "h", "g", "bands", "sketch"])

    return _rows(docs).withColumn("t", F.xxhash64("text")).mapInArrow(
        sign, "doc_id long, t long, n_shingles long, h long, g long, bands array<long>, sketch array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """node and set (sorted 64-bit hashes) of the documents in ``ids``, a written table of nodes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(text, n).tobytes() for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "set"])

    rows = _rows(docs).join(_bounded(ids), F.col("doc_id") == F.col("node")).select("node", "text")
    return staged(rows.mapInArrow(cut, "node long, set binary"))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with ``100 * intersection >= percent * union`` of their whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(k).to_pylist()] for k in (2, 3))
            keep = [_similar(u, v, percent) for u, v in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _sets(docs, staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), n)
    joined = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    )
    return joined.mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node in ``links`` (a, b).

    Alternates two contractions until the links no longer change. In the first, a node hands its larger
    neighbours to the smallest node it knows; in the second its smaller ones. Neighbours are never
    gathered in one place: each node's minimum is an aggregate, joined back to its links.
    """
    def edges(x, y):
        return links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()

    now, mark = staged(edges("a", "b")), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct())
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct())


def _sketched(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Pairs whose sketches differ in at most ``most`` bits."""
    x = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    differ = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(BITS // 64)), F.lit(0))
    return pairs.join(x, "a").join(y, "b").where(differ <= most).select("a", "b")


def _cells(places: DataFrame, labels: DataFrame, payload: DataFrame, least: int) -> DataFrame:
    """Blocks (key, i, j) of buckets with several components: on one side (``asks``) members outside the
    bucket's largest component, on the other any members. Buckets of fewer than ``least`` members are left out."""
    known = places.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = known.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("main"))
    buckets = buckets.where((F.col("parts") > 1) & (F.col("n") >= least)).select(
        "key", F.col("main.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("odd_blocks"))
    rows = known.join(buckets, "key").join(payload, "node")
    extra = [c for c in payload.columns if c != "node"]
    odd = F.col("component") != F.col("main")
    spread = lambda count: F.sequence(F.lit(0), count - 1)
    at = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    asking = rows.where(odd).select("key", "node", "component", *extra, at(F.col("odd_blocks")).alias("i"),
                                    F.explode(spread(F.col("blocks"))).alias("j"), F.lit(True).alias("asks"))
    asked = rows.select("key", "node", "component", *extra, F.explode(spread(F.col("odd_blocks"))).alias("i"),
                        at(F.col("blocks")).alias("j"), F.lit(False).alias("asks"))
    return asking.union(asked)


class _Cell:
    """One block's members, and for each asking one the candidates in other components."""

    def __init__(self, cell: pa.Table, most: int):
        asks = np.asarray(cell["asks"])
        self.key, self.most = cell["key"][0].as_py(), most
        self.node, self.part = np.asarray(cell["node"]), np.asarray(cell["component"]).copy()
        wide = lambda name, n: np.asarray(cell[name].combine_chunks().flatten()).reshape(-1, n)
        self.bands, self.sketch = wide("bands", BANDS), wide("sketch", BITS // 64).view(np.uint64)
        self.asking, self.asked = np.flatnonzero(asks), np.flatnonzero(~asks)

    def near(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates for member ``k`` and the bits by which they differ; of the buckets that a pair shares,
        only the first one counts."""
        others = self.asked[self.part[self.asked] != self.part[k]]
        differ = np.bitwise_count(self.sketch[others] ^ self.sketch[k]).sum(axis=1)
        others, differ = others[differ <= self.most], differ[differ <= self.most]
        shared = self.bands[others] == self.bands[k]
        first = self.bands[k][shared.argmax(axis=1)] == self.key if len(others) else np.zeros(0, bool)
        return others[first], differ[first]


def _pairs(x: list[int], y: list[int]) -> pa.Table:
    a, b = np.asarray(x, np.int64), np.asarray(y, np.int64)
    return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})


def _closest(cells: DataFrame, most: int) -> DataFrame:
    """For each asking member of a block the most similar candidate."""

    def meet(table: pa.Table) -> pa.Table:
        cell, x, y = _Cell(table, most), [], []
        for k in cell.asking:
            others, differ = cell.near(k)
            if len(others):
                x.append(cell.node[k])
                y.append(cell.node[others[np.lexsort((cell.node[others], differ))[0]]])
        return _pairs(x, y)

    return cells.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _with_candidates(cells: DataFrame, most: int) -> DataFrame:
    """Members (key, node) that have a candidate in a block, in the bucket where it counts."""

    def meet(table: pa.Table) -> pa.Table:
        cell, found = _Cell(table, most), []
        for k in cell.asking:
            others, _ = cell.near(k)
            if len(others):
                found += [cell.node[k], *cell.node[others]]
        nodes = np.unique(np.asarray(found, np.int64))
        return pa.table({"key": pa.array(np.full(len(nodes), cell.key, np.int64)), "node": pa.array(nodes)})

    return cells.groupBy("key", "i", "j").applyInArrow(meet, "key long, node long").distinct()


def _connecting(cells: DataFrame, most: int, percent: int) -> DataFrame:
    """Links between components, confirmed on whole sets; a block returns one less than its components at most."""

    def meet(table: pa.Table) -> pa.Table:
        cell, x, y = _Cell(table, most), [], []
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        for k in cell.asking:
            others, differ = cell.near(k)
            for other in others[np.argsort(differ, kind="stable")]:
                if cell.part[other] != cell.part[k] and _similar(sets[k], sets[other], percent):
                    x.append(cell.node[k])
                    y.append(cell.node[other])
                    cell.part[cell.part == cell.part[other]] = cell.part[k]
        return _pairs(x, y)

    return cells.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _judged(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``near_duplicates`` with t, the hash of each row's text."""
    signed = staged(_signatures(docs, n))
    usable = signed.where("h is not null and doc_id is not null")
    classes = staged(usable.groupBy("h", "g").agg(F.min("doc_id").alias("node")))
    first = usable.join(classes, ["h", "g"]).where("doc_id = node").dropDuplicates(["node", "h", "g"])
    nodes = staged(first.select("node", "bands", "sketch"))
    most = most_differing_bits(percent / 100 - MARGIN)
    places = nodes.select("node", F.explode("bands").alias("key"))
    # two orders of members, so that a member of a hot bucket meets two others and not only one
    order = F.struct(F.xxhash64("node", F.pmod("key", F.lit(2))).alias("o"), F.col("node").alias("pivot"))
    buckets = places.groupBy("key").agg(F.min(order).alias("x"), F.count("*").alias("n")).where("n > 1")
    shared = staged(places.join(buckets.select("key", F.col("x.pivot").alias("pivot")), "key"))
    stars = shared.where("node <> pivot").select(
        F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    tested = staged(_sketched(stars, nodes, most))
    links = staged(_confirmed(docs, tested, n, percent))
    places = shared.select("node", "key")
    labels = staged(components(links))
    more = staged(_closest(_cells(places, labels, nodes, 3), most))
    if not more.isEmpty():
        links = staged(links.union(_confirmed(docs, more, n, percent)))
        labels = staged(components(links))
        open_ = staged(_with_candidates(_cells(places, labels, nodes, 3), most))
        if not open_.isEmpty():
            sets = _sets(docs, staged(open_.select("node").distinct()), n).join(nodes, "node")
            links = staged(links.union(_connecting(_cells(open_, labels, sets, 2), most, percent)))
            labels = staged(components(links))
    members = signed.select("doc_id", "t", "n_shingles", "h", "g").join(classes, ["h", "g"], "left")
    found = members.join(labels, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return found.select("doc_id", "t", "n_shingles", own.alias("component_id"),
                        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Texts are linked if their sets of ``n``-word shingles have a Jaccard similarity of ``percent`` / 100 or more;
    component_id is the smallest doc_id that links lead to, and the document with that id is kept. A text without
    words, or null, is linked with nothing; fewer than ``n`` words are one shingle; texts of any length are used
    whole. Rows with an equal id and text are alike; with an equal id and other texts, each is judged by its own
    text. A null id is a document of its own: it is kept, with a null
    component. No rows give none. Other columns are not read.
    """
    return _judged(docs, n, percent).drop("t")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one of the smallest id.

    Of rows with equal id and text one stays, if the text has words; otherwise see ``near_duplicates``.
    """
    judged = staged(_judged(docs, n, percent))
    place = F.struct(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    name = free_name(docs.columns, "removed")
    removed = staged(judged.where(~F.col("kept")).select(F.struct("doc_id", "t").alias(name)).distinct())
    kept = docs.join(_bounded(removed), place == F.col(name), "left_anti")
    again = judged.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "t").count()
    again = staged(again.where("count > 1").select(F.struct("doc_id", "t").alias(name)))
    if again.isEmpty():
        return kept
    once = kept.join(_bounded(again), place == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(_bounded(again), place == F.col(name), "left_anti").unionByName(once)


def _bounded(ids: DataFrame) -> DataFrame:
    """A written table, sent to all executors if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
