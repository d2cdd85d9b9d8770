"""Spans against regular expressions in Python, and discovered identifiers."""

import hashlib
import random
import re

from tidewatch.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, x):
    digits = [int(c) for c in re.sub("[^0-9]", "", x)]
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits[::-1]))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def by_hand(text):
    counts, spans = [], []
    for kind, form in FORMS.items():
        own = [m for m in re.finditer(form, text or "") if valid(kind, m[0])]
        counts.append(len(own))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in own]
    return counts, ",".join(spans)


def check(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, own string")
    rows = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for k, text in enumerate(texts):
        counts, spans = by_hand(text)
        row = rows[k]
        assert [row[f"n_{kind}"] for kind in FORMS] == counts, text[:80]
        assert row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(row["spans"].split(","))
    return rows


def test_odd_texts(spark):
    check(spark, [
        None, "", "a@b.c", "😀😀 x@y.zz 1.2.3.4.5.6.7.8", "a@b.cx%y@d.e", "..a@b@c.d 4111 1111 1111 1111",
        "4111-1111-1111-1112", "+1 (274) 555-9629 +49  30 1234567 +1", "999.1.1.1 001.002.003.004 1.2.3.4.", "5" * 40,
        "4111111111111111" * 3, "1 " * 30, "é+1.2.3.4.5.6.7.8.9 +" + "1 " * 20, "a" * 20_000 + "@b.c", "1.2.3.4" * 50,
        "+" * 50 + "12345678901", "12345678901234567890123.1.1.1 0000000000000.1.1.1", "(" * 100 + "+1((((((((",
        "9" * 5000, "1-2" * 4000,
    ])


def test_random_texts(spark):
    rng = random.Random(2)
    check(spark, ["".join(rng.choices("1234.-+@ a(é😀", k=rng.randrange(150))) for _ in range(800)])


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    known = [(k, f"you may write to my mail u{k}.x@host.org when free") for k in range(12)]
    unseen = [(20 + k, f"so here is my mail user{k:03d}(at)host when done") for k in range(3)]
    other = [(40 + k, f"the part with number {k}4567 is gone and 12{k}45 when sold") for k in range(9)]
    df = spark.createDataFrame(known + unseen + other, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert {i for i, r in rows.items() if r["n_added"]} == {20, 21, 22}
    start = unseen[0][1].index("user")
    assert rows[20]["spans"] == f"email:{start}:{start + len('user000(at)host')}" and rows[20]["n_email"] == 0


def test_found_values_make_patterns_and_are_marked_everywhere(spark):
    rows = [f"please write to u{k}.x@host.org today" for k in range(60)]
    rows += [f"please write to agent{k}@intranet{k} today" for k in range(12)]
    rows += [f"badge holder agent{k}@intranet{k} entered" for k in range(12)]
    rows += [f"badge holder guest{k}@lobby{k} entered" for k in range(2)]
    rows += ["nobody knows guest1@lobby1 here", "and agent3@intranet3", "room 12345 is free", "part 55@77 is lost"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    added = {i for i, r in got.items() if r["n_added"]}
    assert added == set(range(60, 88))  # two hops, and both alone
    start = rows[86].index("guest1")
    assert got[86]["spans"] == f"email:{start}:{start + len('guest1@lobby1')}"


def test_recall_and_precision_of_planted_identifiers(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    frames = [("mail me at", "if you"), ("reach us under", "before noon"), ("signed in as", "since monday")]
    rows, planted, clean = [], set(), set()
    for i in range(900):
        kind, (left, right) = rng.random(), rng.choice(frames)
        name = f"{word()}{i}"
        if kind < 0.56:
            text = f"{left} {name}@{word()}.org {right}"
        elif kind < 0.62:
            text, _ = f"{left} {name}@{word()} {right}", planted.add(i)
        else:
            text, _ = f"{word()} {rng.choice(['order', 'page', 'lot'])} {rng.randrange(100, 10**6)}{word()} {word()}", clean.add(i)
        rows.append((i, f"{word()} {word()} {text} {word()}"))
    got = {r["doc_id"]: r["n_added"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == 1 for i in planted) >= 0.9 * len(planted)
    assert sum(got[i] > 0 for i in clean) <= 0.01 * len(clean)


def test_copies_of_one_document_are_no_support(spark):
    df = spark.createDataFrame([(k, "my mail one@host.org when") for k in range(30)]
                               + [(99, "my mail x123(at)host when")], "doc_id long, text string")
    assert sum(r["n_added"] for r in pii.personal_data(df).collect()) == 0


def test_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_email"] for r in pii.personal_data(df).collect()) == [0, 1, 1]
    assert pii.personal_data(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    pii.personal_data(df).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_tables_between_the_steps_are_few_files(spark, monkeypatch):
    """Each file costs a command of the size of the executor, on a local file system, however little is in it."""
    paths, staged = [], pii.staged
    monkeypatch.setattr(pii, "staged", lambda df: paths.append((out := staged(df)).inputFiles()) or out)
    texts = [f"write to a{k}@b{k}.org today" for k in range(40)] + [f"write to a{k}@b{k} today" for k in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30)
    wanted = sorted(map(tuple, pii.personal_data(df.coalesce(1)).collect()))
    paths.clear()
    with monkeypatch.context() as held:
        held.setattr(pii, "FILE_ROWS", 40)
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        try:
            for k, v in zip(before, ("30", "false")):
                spark.conf.set(k, v)
            got = pii.personal_data(df)
            assert got.rdd.getNumPartitions() <= 2 and sorted(map(tuple, got.collect())) == wanted
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    assert sum(r[-1] for r in wanted) == 8 and len(paths) > 5 and all(len(files) <= 2 for files in paths)
