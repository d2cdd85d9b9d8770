"""Near-duplicates against all pairs of small tables."""

import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewatch.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[k:] for k in range(n)]))


def brute(docs, n, percent=80):
    """doc_id -> (size, component)."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(spark, docs, n):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
            for r in neardup.near_duplicates(df, n).collect()}


def words(rng, n):
    return ["".join(rng.choices("abcdefg", k=4)) for _ in range(n)]


def edited(rng, base, share):
    return [rng.choice("xyz") + w if rng.random() < share else w for w in base]


@pytest.mark.parametrize("n", [2, 5])
def test_groups_of_edited_copies(spark, n):
    rng = random.Random(n)
    texts = []
    for _ in range(12):
        base = words(rng, 60)
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05]))) for _ in range(6)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    expected = brute(docs, n)
    assert found(spark, docs, n) == {i: (s, c, i == c) for i, (s, c) in expected.items()}


def test_a_large_group_that_is_only_partly_linked(spark, monkeypatch):
    """Copies around the threshold, in blocks of a few members, so that all steps take part."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    base = words(rng, 80)
    docs = [(i, " ".join(edited(rng, base, rng.choice([0.03, 0.05, 0.07, 0.1])))) for i in range(150)]
    expected = brute(docs, 2)
    assert len({c for _, c in expected.values()}) > 5
    assert found(spark, docs, 2) == {i: (s, c, i == c) for i, (s, c) in expected.items()}


def test_odd_rows(spark):
    docs = [(7, None), (3, ""), (5, " \t\n"), (9, "one"), (2, "ONE"), (4, "a b c"), (6, "A b C "), (8, "É x"),
            (10, "é x"), (11, "w" * 5000 + " " + "long " * 30000), (12, "x" * 30 + " b"), (None, "a b c")]
    got = found(spark, docs, 2)
    assert got[7] == (0, 7, True) and got[3] == (0, 3, True) and got[5] == (0, 5, True)
    assert got[9] == (1, 2, False) and got[2] == (1, 2, True)
    assert got[6] == (2, 4, False) and got[4] == (2, 4, True)
    assert got[8] == (1, 8, True) and got[10] == (1, 10, True)
    assert got[None] == (2, None, True)
    assert found(spark, [], 2) == {}


def test_deduplicated_keeps_one_of_each_and_all_columns(spark):
    rows = [(1, "a b c d e f", "s", 1), (1, "a b c d e f", "s", 1), (2, "A B c d e f", "t", 2), (3, "z y x w v", "t", 3),
            (4, None, "t", 4), (5, "", None, 5), (5, "", None, 5), (None, "a b c d e f", "u", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, key long")
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["key"]) for r in kept.collect()) == [(0, 6), (1, 1), (3, 3), (4, 4), (5, 5), (5, 5)]


def test_clashing_columns(spark):
    names = ["removed", "again", "t", "kept", "n_shingles", "component_id", "row", "node", "h", "g", "key", "count", "component"]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (3, "z y x w v"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"own {n}") for n in names})
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4]
    assert all(r[n] == f"own {n}" for r in got for n in names)
    assert neardup.near_duplicates(df).count() == 5


def test_an_odd_sketch_estimates_high_similarity(spark):
    rng = np.random.default_rng(1)
    for similarity in (0.8, 0.9):
        shared = rng.integers(0, 1 << 63, 900, np.uint64)
        own = int(900 * (1 - similarity) / similarity / 2)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, own, np.uint64)])) for _ in range(2))
        bits = [neardup.odd_sketch(neardup.minhashes(s)).view(np.uint64) for s in (x, y)]
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert differ <= neardup.most_differing_bits(similarity - 0.15)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_sketches_miss_far_fewer_pairs_than_bands():
    """Exact rates for one pair at the threshold: values that differ, with and without a band that agrees, and the
    bits that twice as many flips leave set."""
    similarity = 0.8
    row = np.array([math.comb(neardup.ROWS, k) * similarity ** (neardup.ROWS - k) * (1 - similarity) ** k
                    for k in range(neardup.ROWS + 1)])
    differing = row[1:]
    every, unmet = np.ones(1), np.ones(1)
    for _ in range(neardup.BANDS):
        every, unmet = np.convolve(every, row), np.convolve(unmet, np.append(0, differing))
    most = neardup.most_differing_bits(similarity - neardup.MARGIN)
    share = np.arange(neardup.BITS + 1) / neardup.BITS
    bits, rejected = np.eye(1, neardup.BITS + 1)[0], 0.0
    for met in every - unmet:
        rejected += met * bits[most + 1:].sum()
        for _ in range(2):
            bits = np.append(0, (bits * (1 - share))[:-1]) + np.append((bits * share)[1:], 0)
    assert unmet.sum() < 1 / 300_000
    assert rejected < unmet.sum() / 10
    assert rejected + unmet.sum() < 1 / 300_000
