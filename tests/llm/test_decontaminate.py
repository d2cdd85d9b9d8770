"""Alignment against the plain recurrence; planted passages are found and nothing else."""

import random

import numpy as np

from tidewatch.llm import decontaminate as d


def plain_score(x, y):
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    best = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            step = d.MATCH if x[i - 1] == y[j - 1] else d.MISMATCH
            rows[i][j] = max(0, rows[i - 1][j - 1] + step, rows[i - 1][j] + d.GAP, rows[i][j - 1] + d.GAP)
            best = max(best, rows[i][j])
    return best


def test_alignment(spark):
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        a, b = np.asarray(x, np.uint64), np.asarray(y, np.uint64)
        score, start, end = d.align(a, b)
        assert score == plain_score(x, y) / (2 * len(x))
        assert plain_score(x, y[start:end]) == plain_score(x, y)


def text(rng, n):
    return ["".join(rng.choices("bcdfglmnprst", k=rng.randrange(2, 7))) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(2)
    items = [(k, " ".join(text(rng, rng.randrange(12, 40)))) for k in range(12)]
    docs, planted = [], set()
    for i in range(80):
        words = text(rng, rng.randrange(0, 200))
        if i % 2:
            k = i % 12
            passage = items[k][1].split()
            if i % 3 == 0:
                passage = [w if rng.random() > 0.12 else "zzz" for w in passage if rng.random() > 0.04]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in passage]
            planted.add((i, k))
        docs.append((i, " ".join(words), 5))
    docs += [(100, None, 5), (101, "", 5), (102, "word " * 100_000 + items[0][1], 5), (None, items[1][1], 5)]
    docs += [(103, items[2][1], 5)] * 2
    more = items + [(50, None), (51, ""), (None, "a b c d e f g"), (52, "one two"), (3, items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    found = d.leaks(df, spark.createDataFrame(more, "item_id long, text string"))
    assert found.columns == ["doc_id", "item_id", "score", "start_word", "end_word"]
    rows = found.collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == planted | {(102, 0), (None, 1), (103, 2)}
    assert len(rows) == len(planted) + 4
    whole = next(r for r in rows if r["doc_id"] == 102)
    assert whole["score"] == 1.0 and whole["start_word"] == 100_000
    clean = d.clean(df, spark.createDataFrame(more, "item_id long, text string"))
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in docs} - {i for i, _ in got}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.leaks(df, none).collect() == [] and d.leaks(df.limit(0), items).collect() == []
    assert d.clean(df, none).count() == 1


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 3)
    rng = random.Random(4)
    items = [(k, " ".join(text(rng, 20))) for k in range(8)]
    df = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    found = d.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(8)}


def by_alignment(docs, items, threshold=0.5):
    """Every item aligned with every whole document."""
    found = {}
    for i, text in docs:
        words = d.plain_hashes(text)
        for k, item in items:
            own = d.plain_hashes(item)
            score = d.align(own, words)[0]
            if score >= threshold:
                found[i, k] = score
            elif d.passage(own, words)[0] >= d.PASSAGE:
                found[i, k] = None
    return found


def edited(rng, words, share, every=0):
    """Words replaced, put in or left out."""
    out = []
    for n, w in enumerate(words):
        if every and n % every == every - 1 or not every and rng.random() < share:
            kind = 0 if every else rng.randrange(4)
            out += [["zq"], ["zq"], [], [w, "zq"]][kind]
        else:
            out.append(w)
    return out


def test_every_stretch_that_reaches_the_threshold_is_found(spark):
    """Few different words, so that pairs are common, and a quarter to a third of them edited."""
    rng = random.Random(7)
    few = text(rng, 60)
    items = [(k, " ".join(rng.choices(few, k=n) if k % 2 else text(rng, n)))
             for k, n in enumerate([5, 6, 7, 9, 12, 16, 16, 20, 20, 30, 30, 40, 40, 59, 59, 150])]
    docs = []
    for i in range(320):
        words = rng.choices(few, k=rng.randrange(60))
        item = items[i % len(items)][1].split()
        words[0:0] = edited(rng, item, rng.choice([0.25, 0.29, 0.33]), every=[0, 4, 3, 0][i // len(items) % 4])
        docs.append((i, " ".join(rng.choices(few, k=rng.randrange(40)) + words)))
    # a word put in after each word leaves no two words of the item side by side
    docs.append((1000, " ".join(w + " zq" for w in items[8][1].split())))
    expected = by_alignment(docs, items)
    assert (1000, 8) in expected and sum(v is not None for v in expected.values()) > 150
    rows = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == set(expected)
    for r in rows:
        score = expected[r["doc_id"], r["item_id"]]
        assert r["score"] < 0.5 if score is None else r["score"] == score


def test_passages_of_long_items(spark):
    rng = random.Random(8)
    long = {n: text(rng, n) for n in (59, 150, 300)}
    parts = {(59, 29), (150, 74), (300, 149), (300, 13)}
    docs, wanted = [], set()
    for n, m in sorted(parts):
        docs.append((n * 1000 + m, " ".join(text(rng, 50) + long[n][20:20 + m] + text(rng, 50))))
        wanted.add((n * 1000 + m, n))
    every_tenth = [w if k % 10 else "zq" for k, w in enumerate(long[300][:120])]
    docs += [(1, " ".join(every_tenth)), (2, " ".join(long[300][5:17])), (3, " ".join(text(rng, 400)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in long.items()], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in d.leaks(df, items).collect()}
    assert set(rows) == wanted | {(1, 300)}
    assert (rows[300013, 300]["start_word"], rows[300013, 300]["end_word"]) == (50, 63)
    assert {r["doc_id"] for r in d.clean(df, items).collect()} == {2, 3}


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "\u5929\u5730\u7384\u9ec4\u5b87\u5b99\u6d2a\u8352\u65e5\u6708\u76c8\u6603"
    items = [(1, "Paris, France"), (2, "xyzzy"), (3, chinese), (4, "?!"), (5, chinese[:3])]
    docs = [(1, "it is paris france now"), (2, "paris in france"), (3, "a XYZZY."), (4, "\u6211" + chinese + "\u3002\u4e86"),
            (5, "\u6211" + chinese[:5] + "\u4e86" + chinese[6:]), (6, chinese[9:]), (7, "?!")]
    rows = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (3, 2), (4, 3), (4, 5), (5, 3), (5, 5)}


def test_pairs_are_counted_in_all_documents(spark):
    rng = random.Random(9)
    few = text(rng, 30)
    docs = [" ".join(rng.choices(few, k=rng.randrange(40))) for _ in range(150)]
    items = [d.plain_hashes(" ".join(rng.choices(few, k=12))) for _ in range(5)]
    grams = np.unique(np.concatenate([d.pairs(x, apart) for x in items for apart in (1, 2)]))
    wanted = {}
    for one in docs:
        words = d.plain_hashes(one)
        for apart in (1, 2):
            for g in d.pairs(words, apart).tolist():
                if g in set(grams.tolist()):
                    wanted[g] = wanted.get(g, 0) + 1
    df = spark.createDataFrame([(t,) for t in [*docs, None, ""]], "text string").repartition(3)
    assert wanted and d._counted(df, grams) == wanted
