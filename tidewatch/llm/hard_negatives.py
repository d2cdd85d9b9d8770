"""Hard negatives by a packed R-tree over integer vectors.

Rows are packed by sort-tile-recursive: range-partitioned by label and by the coordinate that spreads most, and
within chunks of bounded size cut into tiles by further coordinates. A leaf is one row of a table: its vectors, the
box around them (least and largest value per coordinate), the range of their labels and their least id. A search
reads the leaves in batches of bounded size and groups neighbours into upper nodes with boxes of their own.

A box gives an interval for the inner product with an anchor: each coordinate adds its product with the least
or the largest value, whichever is smaller (larger). Nodes wait in a queue by the best score that they can have
inside a window of wanted scores; a node is dropped if its interval misses the window, if its labels are not wanted, if its
best is strictly below the k-th score found, or equal to it and all its ids are larger than the k-th's.

Anchors go to all tasks in blocks of bounded size; each task keeps its k best per anchor and window over all its
batches. Each anchor is first searched in its own chunk, while that is packed: the k-th score found there
is a floor below which no task returns anything. Positives come first, in a window without an end; each positive's
score then gives the window of its negatives. All scores are exact integers.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import staged

#: Components are floor(SCALE * x).
SCALE = 256

#: Components beyond this would take inner products out of 64 bits.
LIMIT = 1 << 26

#: Bytes of the vectors of a leaf, leaves of a tree, children of a node, and bytes of the anchors of a block.
LEAF_BYTES, TREE_LEAVES, FANOUT, BLOCK_BYTES = 1 << 16, 256, 16, 1 << 23

#: Scores stay inside these.
LEAST, MOST = -(1 << 62), 1 << 62

ROW_SCHEMA = "vec_id long, label long, point array<int>, anchor boolean"
LEAF_SCHEMA = """min_id long, low_label long, high_label long, low array<int>, high array<int>,
  ids array<long>, labels array<long>, points array<int>, floors array<long>"""
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# --- the tree -------------------------------------------------------------------------------------


def tiles(points: np.ndarray, axes: list[int], size: int) -> Iterator[np.ndarray]:
    """Row numbers of ``points`` in tiles of at most ``size``, neighbours after each other."""

    def cut(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        leaves = -(-len(rows) // size)
        if leaves <= 1 or depth == len(axes):
            for at in range(0, len(rows), size):
                yield rows[at:at + size]
            return
        rows = rows[np.argsort(points[rows, axes[depth]], kind="stable")]
        slabs = int(np.ceil(leaves ** (1 / (len(axes) - depth)) - 1e-9))
        step = -(-leaves // slabs) * size
        for at in range(0, len(rows), step):
            yield from cut(rows[at:at + step], depth + 1)

    return cut(np.arange(len(points)), 0)


@dataclass
class Leaf:
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray  # one row each


@dataclass
class Best:
    """The best scores of one window, as (-score, id) in order."""

    low: int
    high: int
    size: int
    found: list[tuple[int, int]] = field(default_factory=list)

    def full(self) -> bool:
        return len(self.found) == self.size

    def need(self) -> int:
        """The least score that may still matter."""
        return max(self.low, -self.found[-1][0]) if self.full() else self.low

    def open(self, best: int, min_id: int) -> bool:
        """May a node of this best score and least id add anything?"""
        if not self.full():
            return best >= self.low
        return (-best, min_id) < self.found[-1]

    def add(self, score: int, vec_id: int) -> None:
        entry = (-score, vec_id)
        if self.full():
            if entry >= self.found[-1]:
                return
            self.found.pop()
        insort(self.found, entry)


class Tree:
    """A packed tree over leaves that follow each other."""

    def __init__(self, leaves: list[Leaf]):
        self.leaves = leaves
        width = leaves[0].points.shape[1]
        most = max((int(np.abs(leaf.points).max(initial=0)) for leaf in leaves), default=0)
        self.bound = most * width  # times an anchor's largest component: no score or bound is larger
        low = np.stack([leaf.points.min(axis=0) for leaf in leaves])
        high = np.stack([leaf.points.max(axis=0) for leaf in leaves])
        tags = np.stack([
            np.array([leaf.labels.min() for leaf in leaves]), np.array([leaf.labels.max() for leaf in leaves]),
            np.array([leaf.ids.min() for leaf in leaves])])
        self.levels = [(low, high, tags)]
        while len(low) > FANOUT:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            tags = np.stack([
                np.minimum.reduceat(tags[0], starts), np.maximum.reduceat(tags[1], starts), np.minimum.reduceat(tags[2], starts)])
            self.levels.append((low, high, tags))
        self._typed: dict[type, tuple] = {}

    def typed(self, anchor_most: int) -> tuple:
        """Boxes and vectors in a type that holds all sums of products exactly: doubles, if they can."""
        kind = np.float64 if self.bound * anchor_most < 1 << 53 else np.int64
        if kind not in self._typed:
            self._typed[kind] = (
                kind, [(low.astype(kind), high.astype(kind)) for low, high, _ in self.levels],
                [leaf.points.astype(kind) for leaf in self.leaves])
        return self._typed[kind]

    def search(self, anchor: np.ndarray, label: int, same: bool, without: int | None, wanted: list[Best]) -> int:
        """Improve ``wanted`` by the rows of the anchor's label (``same``) or of others; returns the leaves visited.

        ``without`` is an id that doesn't count.
        """
        kind, boxes, points = self.typed(int(np.abs(anchor).max(initial=0)))
        anchor = anchor.astype(kind)
        above, below = np.maximum(anchor, 0), np.minimum(anchor, 0)
        highs = [best.high for best in wanted]
        queue: list[tuple] = []

        def push(level: int, start: int, end: int) -> None:
            low, high = boxes[level][0][start:end], boxes[level][1][start:end]
            upper, lower = (high @ above + low @ below), (low @ above + high @ below)
            first, last, ids = self.levels[level][2][:, start:end]
            fits = (first <= label) & (last >= label) if same else (first != label) | (last != label)
            fits &= upper >= min(best.need() for best in wanted)
            for k in np.flatnonzero(fits).tolist():
                most, least, min_id = int(upper[k]), int(lower[k]), int(ids[k])
                reach = [min(most, best.high) for best in wanted if least <= best.high and best.open(min(most, best.high), min_id)]
                if reach:
                    heapq.heappush(queue, (-max(reach), min_id, level, start + k, least, most))

        top = len(self.levels) - 1
        push(top, 0, len(boxes[top][0]))
        visited = 0
        while queue:
            best_score, min_id, level, node, least, most = heapq.heappop(queue)
            if all(best.full() and min(-best_score, high) < best.need() for best, high in zip(wanted, highs)):
                break
            if not any(least <= best.high and best.open(min(most, best.high), min_id) for best in wanted):
                continue
            if level:
                push(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(boxes[level - 1][0])))
                continue
            visited += 1
            leaf, scores = self.leaves[node], points[node] @ anchor
            fits = (leaf.labels == label) if same else (leaf.labels != label)
            if without is not None:
                fits &= leaf.ids != without
            fits &= (scores >= min(best.need() for best in wanted)) & (scores <= max(highs))
            rows = np.flatnonzero(fits)
            for k in rows[np.lexsort((leaf.ids[rows], -scores[rows]))].tolist():
                score, vec_id = int(scores[k]), int(leaf.ids[k])
                for best in wanted:
                    if best.need() <= score <= best.high:
                        best.add(score, vec_id)
        return visited


# --- packing --------------------------------------------------------------------------------------


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of squares per coordinate."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.asarray(lists.value_lengths())
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.repeat(sizes == size, sizes)
            rows = values[at].reshape(-1, size)
            found = np.stack([np.full(size, len(rows)), rows.sum(axis=0), (rows * rows).sum(axis=0)])
            sums[size] = sums.get(size, 0) + found
    for size, (count, total, squares) in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"axis": pa.array(np.arange(size), pa.int32()), "count": count, "total": total, "squares": squares})


def widest(rows: DataFrame) -> list[int]:
    """All coordinates, those of the largest variance first; missing ones count as zero."""
    count = F.lit(float(max(1, rows.count())))
    sums = rows.select("point").mapInArrow(_spread, "axis int, count double, total double, squares double").groupBy("axis").agg(
        (F.sum("squares") / count - F.pow(F.sum("total") / count, 2)).alias("variance"))
    return [r["axis"] for r in sorted(sums.collect(), key=lambda r: (-r["variance"], r["axis"]))]


def _matrix(lists: Iterable[list[int]], width: int) -> np.ndarray:
    rows = list(lists)
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


def _points(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one width; shorter ones are filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    if (sizes == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    return _matrix(column.to_pylist(), width)


def leaf_rows(width: int) -> int:
    return max(16, min(256, LEAF_BYTES // (4 * max(1, width))))


def _pack(axes: list[int], width: int, k: int):
    size = leaf_rows(width)
    most = size * TREE_LEAVES

    def leaves_of(labels, points) -> Iterator[np.ndarray]:
        depth = max(1, int(np.log2(max(2, len(labels) / size))))
        values, counts = np.unique(labels, return_counts=True)
        own = set(values[counts >= size].tolist())  # labels with leaves of their own; the others share some
        for label in [*sorted(own), None]:
            rows = np.flatnonzero(labels == label if label is not None else ~np.isin(labels, list(own)))
            for tile in tiles(points[rows], axes[:depth] if label is not None else [], size):
                yield rows[tile]

    def chunk(ids, labels, points, anchors) -> pa.RecordBatch:
        members = list(leaves_of(labels, points))
        leaves = [Leaf(ids[rows], labels[rows], points[rows]) for rows in members]
        tree, floors = Tree(leaves), {}
        for row in np.flatnonzero(anchors).tolist():
            best = Best(LEAST, MOST, k)
            tree.search(points[row], int(labels[row]), True, int(ids[row]), [best])
            floors[row] = best.need()
        low, high, (low_label, high_label, min_id) = tree.levels[0]
        as_lists = lambda arrays, kind: pa.array([np.asarray(a).ravel() for a in arrays], pa.list_(kind))
        return pa.RecordBatch.from_pydict({
            "min_id": pa.array(min_id, pa.int64()), "low_label": pa.array(low_label, pa.int64()),
            "high_label": pa.array(high_label, pa.int64()),
            "low": as_lists(low.astype(np.int32), pa.int32()), "high": as_lists(high.astype(np.int32), pa.int32()),
            "ids": as_lists([leaf.ids for leaf in leaves], pa.int64()),
            "labels": as_lists([leaf.labels for leaf in leaves], pa.int64()),
            "points": as_lists([leaf.points.astype(np.int32) for leaf in leaves], pa.int32()),
            "floors": pa.array([list(map(floors.get, rows.tolist())) for rows in members], pa.list_(pa.int64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - rows)
                at += piece.num_rows
                rows += piece.num_rows
                held.append((
                    piece.column(0).to_numpy(), piece.column(1).to_numpy(), _points(piece.column(2), width),
                    piece.column(3).to_numpy(zero_copy_only=False)))
                if rows == most:
                    yield chunk(*map(np.concatenate, zip(*held)))
                    held, rows = [], 0
        if held:
            yield chunk(*map(np.concatenate, zip(*held)))

    return run


def packed(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Leaves of all ``rows`` (vec_id, label, point, anchor) as a written table, and the vectors' width."""
    axes = widest(rows)
    first = F.get("point", F.lit(axes[0] if axes else 0))
    order = ["label", F.coalesce(first, F.lit(0)), "vec_id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ranged.mapInArrow(_pack(axes, len(axes), k), LEAF_SCHEMA)), len(axes)


# --- searches -------------------------------------------------------------------------------------


@contextmanager
def _batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Anchor:
    vec_id: int
    label: int
    point: np.ndarray
    windows: list[tuple[int, int]]  # (least, largest) score


def _search(anchors, same: bool, width: int, k: int):
    """Rows (anchor: its number, high: its window's end, score, vec_id), at most ``k`` per anchor and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Anchor] = anchors.value
        wanted = [[Best(low, high, k) for low, high in anchor.windows] for anchor in own]
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_LEAVES):
                part = batch.slice(at, TREE_LEAVES)
                columns = [part.column(name) for name in ("ids", "labels", "points")]
                leaves = [
                    Leaf(ids.values.to_numpy(), labels.values.to_numpy(),
                         points.values.to_numpy().astype(np.int64).reshape(len(ids.values), width))
                    for ids, labels, points in zip(*columns)]
                tree = Tree(leaves)
                for anchor, best in zip(own, wanted):
                    if best:
                        tree.search(anchor.point, anchor.label, same, anchor.vec_id, best)
        found = [
            (number, best.high, -score, vec_id)
            for number, bests in enumerate(wanted) for best in bests for score, vec_id in best.found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 4)], ["anchor", "high", "score", "vec_id"])

    return run


def _first(leaves: DataFrame, anchors: list[Anchor], same: bool, width: int, k: int) -> DataFrame:
    """(anchor, high, score, vec_id, rank): the first ``k`` of all tasks, written."""
    spark = leaves.sparkSession
    shared = spark.sparkContext.broadcast(anchors)
    best = Window.partitionBy("anchor", "high").orderBy(F.desc("score"), "vec_id")
    found = leaves.select("ids", "labels", "points").mapInArrow(
        _search(shared, same, width, k), "anchor long, high long, score long, vec_id long")
    with _batch_rows(spark, TREE_LEAVES):
        return staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def _block(rows: DataFrame, leaves: DataFrame, width: int, positives: int, negatives: int, least: int) -> DataFrame:
    """Results of the anchors ``rows`` (vec_id, label, floor, point), which fit the driver and each task."""
    anchors = [
        Anchor(r["vec_id"], r["label"], _matrix([r["point"]], width)[0], [(r["floor"], MOST)]) for r in rows.collect()]
    first = _first(leaves, anchors, True, width, positives)
    scores: dict[int, set[int]] = {}
    for r in first.select("anchor", "score").collect():
        scores.setdefault(r["anchor"], set()).add(r["score"])
    for number, anchor in enumerate(anchors):
        lows = ((-(-least * score // 100), score) for score in scores.get(number, ()))
        anchor.windows = sorted((low, high) for low, high in lows if low <= high)
    second = _first(leaves, anchors, False, width, negatives)
    names = leaves.sparkSession.createDataFrame([(n, a.vec_id) for n, a in enumerate(anchors)], "number long, anchor_id long")
    pairs = first.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = second.select(
        F.col("anchor").alias("number"), F.col("high").alias("positive_score"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = pairs.withColumnRenamed("anchor", "number").join(found, ["number", "positive_score"]).join(names, "number")
    return staged(joined.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hard negatives of the rows that ``anchor`` marks, among all ``rows`` (vec_id, embedding, label).

    Components become floor(256 * x); a score is the integer inner product with the anchor, larger ones first, equal ones
    by id. An anchor's positives are the first rows of its label; for each, the negatives are the first rows of
    other labels with ``least`` to 100 hundredths of the positive's score. Returns (anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score).

    Rows without id, label or vector, or with a null, non-finite or huge component (262,144 or more), take no part.
    Shorter vectors are filled up with zeros. Repeated rows count each; a row of the anchor's own id is not an
    "other" row. Other columns are ignored, whatever their names. No rows or no anchors give no rows.
    """
    spark = rows.sparkSession
    value = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT / SCALE, F.lit(False)))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable
    points = rows.where(valid).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: value(x).cast("int")).alias("point"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    leaves, width = packed(points, positives)
    entry = F.explode(F.arrays_zip("ids", "labels", "floors", F.sequence(F.lit(0), F.size("ids") - 1).alias("at")))
    zipped = leaves.select(entry.alias("entry"), "points").where("entry.floors IS NOT NULL")
    anchors = staged(zipped.select(
        F.col("entry.ids").alias("vec_id"), F.col("entry.labels").alias("label"), F.col("entry.floors").alias("floor"),
        F.slice("points", F.col("entry.at") * width + 1, F.lit(width)).alias("point"),
        F.monotonically_increasing_id().alias("number")))
    count = anchors.count()
    blocks = -(-count * 8 * max(1, width) // block_bytes)
    number = F.pmod(F.xxhash64("number"), F.lit(max(1, blocks)))
    results = [
        _block(anchors.where(number == b), leaves, width, positives, negatives, least) for b in range(blocks)]
    if not results:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return reduce(DataFrame.unionByName, results)
