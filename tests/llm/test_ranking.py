"""Pairwise ranking: against a plain fit, held-out accuracy, and what it does with little."""

import random
import zlib

import numpy as np

import pytest
import xxhash

from tidewatch.llm import ranking
from tidewatch.llm.common import numbered


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(8, 80))]
        good = rng.random() < 0.7
        if not good:
            junk = rng.randrange(3)
            words = ([w.upper() + "!!" for w in words], [w + "$$%" for w in words], words[:4] * 12)[junk]
        docs.append((i, " ".join(words), 0.0))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(600)
    docs += [(900, None, 0.0), (901, "", 0.0), (None, "fine plain words", 0.0), (902, "word " * 100_000, 0.0), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(900, None), (None, 0)], "doc_id long, quality int")
    rows = ranking.quality_scores(df, known).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901]
    kept = ranking.accepted(df, known)
    assert kept.columns == df.columns
    wanted = [r["doc_id"] for r in rows if r["predicted"]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, wanted))


def plain_scores(docs, labels, most, partners):
    """All steps without Spark: examples, pairs, a fit by Newton's method, the threshold and the scores."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    own = {}
    for i, text, *_ in docs:
        if i is not None:
            x = ranking.features_of(text or "")
            own[i] = min(own.get(i, x), x, key=list)
    least = {}
    for i, y in labels:
        if i is not None and y is not None and not held(i) and i in own:
            least[i] = min(y, least.get(i, y))
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    place = lambda i: (signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)), i)
    kinds = [sorted((i for i, y in least.items() if y == k), key=place)[:most] for k in (0, 1)]
    bad, good = [np.array([own[i] for i in ids]) for ids in kinds]
    every = np.concatenate([bad, good])
    mean, scale = every.mean(axis=0), np.where(every.std(axis=0) == 0, 1, every.std(axis=0))
    g, b = (good - mean) / scale, (bad - mean) / scale
    gaps, fewest = [], min(len(g), len(b))
    for k in range(max(len(g), len(b))):
        for j in range(partners):
            p = (k * 7 + 1 + j * max(1, fewest // partners)) % fewest
            gaps.append(g[k] - b[p] if len(g) >= len(b) else g[p] - b[k])
    gaps = np.array(gaps)
    w = np.zeros(gaps.shape[1])
    for _ in range(50):
        share = 1 / (1 + np.exp(gaps @ w))  # mirrored pairs have the same loss
        slope = -(gaps * share[:, None]).mean(axis=0) + 1e-3 * w
        bend = (gaps * (share * (1 - share))[:, None]).T @ gaps / len(gaps) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    worth = lambda x: (np.asarray(x) - mean) @ (w / scale)
    grid = np.quantile(np.concatenate([worth(good), worth(bad)]), np.linspace(0, 1, 1001))
    wrong = [(worth(good) < t).mean() + (worth(bad) >= t).mean() for t in grid]
    best = [t for t, x in zip(grid, wrong) if x <= min(wrong) + 1e-12]
    cut = (best[0] + best[-1]) / 2
    return [(i, 1 / (1 + np.exp(cut - worth(ranking.features_of(text or ""))))) for i, text, *_ in docs]


@pytest.mark.parametrize("most", [40, 5000])
def test_against_a_plain_fit(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "MAX_EXAMPLES", most)
    docs, labels = corpus(400, 5)
    docs += [(900, None, 0.0), (901, "", 0.0), (None, "fine plain words", 0.0), docs[0], (docs[1][0], "other text", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    known = spark.createDataFrame(labels + [(900, None), (None, 0), (3, 1)], "doc_id long, quality int")
    got = sorted(((str(r["doc_id"]), r["score"]) for r in ranking.quality_scores(df, known).collect()))
    want = sorted((str(i), s) for i, s in plain_scores(docs, labels + [(900, None), (None, 0), (3, 1)], most, ranking.PARTNERS))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-3)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_too_little_to_learn_from(spark, labels):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert [r["score"] for r in ranking.quality_scores(df, known).collect()] == [0.5, 0.5]
    assert ranking.quality_scores(df.limit(0), known).collect() == []


def test_all_labelled_documents_are_learned_from(spark, monkeypatch):
    """More examples than were once taken: the means of the features are those of all."""
    learned = []
    own = ranking.fit_ranking
    monkeypatch.setattr(ranking, "fit_ranking", lambda *given: learned.append(own(*given)) or learned[-1])
    rng = random.Random(3)
    docs = [(i, " ".join(["ab", "Cd!", "e"][: rng.randrange(1, 4)] * rng.randrange(1, 9))) for i in range(18_000)]
    labels = [(i, int(len(text) < 20)) for i, text in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    ranking.quality_scores(df, known)
    ranking.accepted(df, known)
    x = np.asarray([ranking.features_of(t) for i, t in docs if zlib.crc32(str(i).encode()) % 3 != 1])
    assert len(x) > 11_000
    for found in learned:
        assert found.mean == pytest.approx(x.mean(axis=0).tolist(), rel=1e-9)


def test_numbers_go_through_all_ranges(spark):
    rng = random.Random(4)
    values = [rng.randrange(500) for _ in range(3_000)]
    df = spark.createDataFrame([(v, "x") for v in values], "v long, place string").repartition(5)
    found = numbered(df, "n", "v")
    assert found.columns == ["v", "place", "n"]
    assert [(r["n"], r["v"]) for r in found.orderBy("n").collect()] == list(enumerate(sorted(values)))
    assert numbered(df.limit(0), "n", "v").collect() == []
