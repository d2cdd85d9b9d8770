"""Nearest examples against all of them, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import pytest

from tidewatch.llm import toxicity

BAD = [b"foul", b"vile", b"rude", b"nasty"]
SAID = [b"kind", b"nice"]


def examples(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.4
        words = rng.choices(BAD if toxic else SAID + BAD[:1], k=rng.randrange(0, 6))
        rows.append((i, int(toxic), dict(Counter(words))))
    return rows


def brute(index, rows, counts, k):
    """All (similarity, toxic share, size) above zero, in order, with ties of the last."""
    vector = index.vector(counts)
    groups = {}
    for _, label, own in rows:
        if own:
            groups.setdefault(tuple(sorted(own.items())), []).append(label)
    sims = []
    for key, labels in groups.items():
        other = index.vector(Counter(dict(key)))
        dot = sum(x * other.get(w, 0) for w, x in vector.items())
        if dot > 0:
            sims.append((round(dot, 12), sum(labels), len(labels)))
    sims.sort(reverse=True)
    return [s for s in sims if len(sims) <= k or s[0] >= sims[k - 1][0]]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_the_index_finds_what_comparing_with_all_finds(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rows = examples(200)
    index = toxicity.build_index(rows, set(BAD + SAID))
    rng = random.Random(2)
    for _ in range(100):
        counts = Counter(rng.choices(BAD + SAID, k=rng.randrange(1, 6)))
        near = index.nearest(index.vector(counts), 7)
        wanted = brute(index, rows, counts, 7)
        assert sorted(s for s, _ in near) == pytest.approx(sorted(s for s, _, _ in wanted))
        assert sorted((index.toxic[e], index.total[e]) for _, e in near) == sorted((t, n) for _, t, n in wanted)
        assert math.isclose(sum(x * x for x in index.vector(counts).values()), 1)


def cosine(idf, a, b, unknown):
    weights = [{w: (1 + math.log(n)) * idf.get(w, unknown) for w, n in c.items()} for c in (a, b)]
    lengths = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    return sum(x * weights[1].get(k, 0) for k, x in weights[0].items()) / (lengths[0] * lengths[1]) if all(lengths) else 0.0


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_whole_vectors_against_all_pairs(least):
    rng = random.Random(5)
    words = [b"w%d" % k for k in range(200)]
    common = rng.choices(words, k=40)
    texts = [rng.choices(words, weights=range(1, 201), k=rng.randrange(0, 40)) for _ in range(150)]
    texts += [common[:k] + rng.choices(words, k=40 - k) for k in range(0, 41, 2)] + [texts[3], texts[4] * 2]
    counted = [Counter(t) for t in texts]
    df = Counter(w for c in counted for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    unknown = math.log(1 + len(texts)) + 1
    index = toxicity.WholeIndex([(i, i % 2, *toxicity.hashed_counts(t)) for i, t in enumerate(texts)])
    for query in [*texts[::5], common, common[:30] + [b"new"] * 3, [b"new"], []]:
        wanted = {i: cosine(idf, Counter(query), c, unknown) for i, c in enumerate(counted)}
        got = {i: s for s, i in index.near(*toxicity.hashed_counts(query), least)}
        assert got == {i: pytest.approx(s) for i, s in wanted.items() if s >= least - 1e-9}


def test_copies_of_texts_with_rare_words(spark):
    """Toxic by words that occur a few times each: no word tells the label, but copies are found."""
    rng = random.Random(12)
    rare = ["bad" + "".join(rng.choices("mnopqrst", k=6)) for _ in range(250)]
    docs, labels = corpus(1200, 8)
    docs = [(i, t.replace("Foul,", "x").replace("vile.", "x").replace("RUDE", "x"), *rest) for i, t, *rest in docs]
    docs = [(i, t + " " + " ".join(rng.choices(rare, k=4)) if label else t, *rest) for (i, t, *rest), (_, label) in zip(docs, labels)]
    toxic = [d for d, (_, label) in zip(docs, labels) if label and not held(d[0])]
    plain = [d for d, (_, label) in zip(docs, labels) if not label and not held(d[0])]
    # copies of learned texts under held-out ids, and copies with one word put in
    ids = iter(i for i in range(5000, 10**6) if held(i))
    copies = [(next(ids), t, "c", 1) for _, t, *_ in toxic[:60]] + [(next(ids), t + " indeed", "c", 1) for _, t, *_ in toxic[:60]]
    clean = [(next(ids), t, "c", 1) for _, t, *_ in plain[:60]]
    schema = "doc_id long, text string, terms string, score int"
    df = spark.createDataFrame(docs + copies + clean, schema)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, known).collect()}
    assert sum(got[d[0]]["predicted"] for d in copies) == len(copies)
    assert sum(got[d[0]]["predicted"] for d in clean) == 0
    assert all(got[c[0]]["nearest"] for c in copies)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randrange(5, 60))
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Foul,", "vile.", "RUDE"]))
        docs.append((i, " ".join(words), "l", 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(500)
    docs += [(900, None, "l", 1), (901, "", "l", 1), (None, "foul vile", "l", 1), (902, "foul " * 30_000, "l", 1)]
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id long, text string, terms string, score int")
    known = spark.createDataFrame(labels + [(901, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(df, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "nearest", "terms"]
    rows = got.collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[900]["score"] == by_id[901]["score"] < 0.2 and by_id[900]["nearest"] == []
    assert by_id[None]["predicted"] == by_id[902]["predicted"] == 1 and not by_id[None]["held_out"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.toxicity_scores(df, none).collect()] == [(0.5, 0)]
    assert toxicity.toxicity_scores(df.limit(0), none).collect() == []
