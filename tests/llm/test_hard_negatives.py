"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, step=100, positives=5, negatives=5, least=80):
    points = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) and abs(x) < h.LIMIT / h.SCALE for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in points:
        if i % step:
            continue
        scored = sorted((-dot(v, w), j, other) for j, w, other in points if j != i)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, pid, k + 1, j, -p, -n) for k, (n, j, _) in enumerate(found)]
    return sorted(out)


def found(df, step=100, **options):
    return sorted(map(tuple, h.hard_negatives(df, F.col("vec_id") % step == 0, **options).collect()))


def made(seed, n, width, labels, spread=0.3):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, spread) for _ in range(width)], rng.randrange(labels)) for k in range(n)]


@pytest.fixture
def small_nodes(monkeypatch):
    monkeypatch.setattr(h, "LEAF_BYTES", 64)
    monkeypatch.setattr(h, "TREE_LEAVES", 8)
    monkeypatch.setattr(h, "FANOUT", 2)


@pytest.mark.parametrize("width, labels", [(2, 3), (8, 2), (16, 30)])
def test_against_all_pairs(spark, width, labels, small_nodes):
    rows = made(width, 700, width, labels)
    rows += [(1000 + k, [0.25] * width, k % 2) for k in range(300)]  # one very common vector: ties by id
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, 50) == by_hand(rows, 50)


def test_odd_rows(spark):
    rows = made(1, 300, 4, 3)
    rows += [
        (None, [1.0] * 4, 1), (2000, None, 1), (2100, [1.0] * 4, None), (2200, [float("nan"), 1, 1, 1], 1), (2300, [None, 1.0, 1.0, 1.0], 2),
        (2400, [float("inf"), 1, 1, 1], 1), (2500, [1e30, 1, 1, 1], 1), (2600, [], 1), (2700, [0.5], 2), (2800, [-0.5, 0.25], 0), (-100, [0.3] * 4, -5),
        (2900, [200_000.0] * 4, 1), (2901, [199_000.0] * 4, 1), (2902, [198_000.0] * 4, 2), *made(1, 5, 4, 3)]
    rows += [(3000, [0.1, 0.2, 0.3, 0.4], 0), (3000, [-0.1, 0.2, 0.5, 0.4], 1)]  # one id, two labels
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    table = [(*r, "x", 1, 2.0) for r in rows]
    df = spark.createDataFrame(table, f"{SCHEMA}, anchor string, floors int, point double").repartition(3)
    assert found(df) == by_hand(rows)
    assert found(df, least=100, positives=2, negatives=9) == by_hand(rows, least=100, positives=2, negatives=9)


def test_blocks_of_anchors(spark):
    rows = made(3, 400, 3, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, 10, block_bytes=300) == by_hand(rows, 10)


def test_nothing(spark):
    df = spark.createDataFrame(made(3, 20, 3, 2), SCHEMA)
    assert found(df.limit(0)) == [] and found(df.where("vec_id > 0")) == []
    assert found(df.withColumn("embedding", F.expr("cast(array() as array<float>)"))) == by_hand([(k, [], lab) for k, _, lab in made(3, 20, 3, 2)])


def test_boxes_prune():
    rng = np.random.default_rng(2)
    points = rng.integers(-200, 200, (4000, 2))
    leaves = [h.Leaf(t.astype(np.int64), np.zeros(len(t), np.int64), points[t]) for t in h.tiles(points, [0, 1], 16)]
    tree = h.Tree(leaves)
    assert sorted(np.concatenate([leaf.ids for leaf in leaves]).tolist()) == list(range(4000))
    best = h.Best(h.LEAST, h.MOST, 5)
    visited = tree.search(points[7], 0, True, 7, [best])
    scores = points @ points[7]
    order = [i for i in np.lexsort((np.arange(4000), -scores)).tolist() if i != 7][:5]
    assert [i for _, i in best.found] == order
    assert visited < len(leaves) / 10
    window = h.Best(int(scores[order[4]]) // 2, int(scores[order[4]]) // 2 + 300, 5)
    assert tree.search(points[7], 1, False, None, [window]) < len(leaves) / 3


def test_ties_are_pruned_by_id():
    leaves = [h.Leaf(np.arange(k, k + 4), np.ones(4, np.int64), np.full((4, 3), 9)) for k in range(0, 400, 4)]
    best = h.Best(h.LEAST, h.MOST, 5)
    assert h.Tree(leaves).search(np.ones(3, np.int64), 0, False, None, [best]) == 2
    assert best.found == [(-27, k) for k in range(5)]
