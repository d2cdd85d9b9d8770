"""Counts against plain counting; verdicts of domains."""

import random
import re

from tidewatch.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    marked = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def test_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "b", "é", "😀", "#", "|"], k=4)) for _ in range(5)]
    texts = [" ".join(rng.choices(texts, k=rng.randrange(40))) + "\n" * rng.randrange(3) for _ in range(100)]
    texts = [t.replace(" ", "\n", rng.randrange(6)) for t in texts]
    texts += [None, "", " \t\r\n\x0b\x0c ", "a" * 9, "\n\n", "x\x85y\u2003z", "one two " * 20_000]
    df = spark.createDataFrame([(k, t, None, 1) for k, t in enumerate(texts)],
                               "doc_id long, text string, source string, domain int")
    got = rules.quality_rules(df).collect()
    short = {k: t for k, t in enumerate(texts) if not t or len(t) < 10_000}
    for r in got:
        if r["doc_id"] in short:
            assert tuple(r[c] for c in rules.COUNTS) == by_hand(short[r["doc_id"]])
        else:
            assert (r["n_words"], r["n_repeat_words"]) == (40_000, 40_000)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert len(got) == len(texts)


def test_domains(spark):
    good, bad = " ".join(f"word{k}" for k in range(30)), "same words again and over " * 10
    rows = [(k, good, "fine") for k in range(60)] + [(100 + k, bad, "fine") for k in range(3)]
    rows += [(200 + k, bad, "spam") for k in range(60)] + [(300, good, "spam")]
    rows += [(400, bad, None), (401, good, None), (500, good, "one"), (500, good, "one"), (None, good, "fine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rules.quality_rules(df).collect()
    assert len(got) == len(rows)
    kept = {(r["doc_id"], r["domain"]): r["kept"] for r in got}
    assert all(kept[k, "fine"] for k in range(60)) and not any(kept[100 + k, "fine"] for k in range(3))
    assert not kept[300, "spam"] and kept[500, "one"] and kept[None, "fine"]
    assert not kept[400, None]
    assert rules.quality_rules(df.limit(0)).collect() == []
