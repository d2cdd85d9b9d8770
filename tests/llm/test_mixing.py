"""Targets, flow and selection against plain ways to get them."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 1000], [2, 1]) == [30, 980]
    assert mixing.targets([0, 5], [1, 1]) == [0, 5]
    assert mixing.targets([], []) == []


def test_flow_costs_as_little_as_the_best_of_all():
    rng = random.Random(1)
    for _ in range(25):
        patterns = [(tuple(sorted(rng.sample(range(2), rng.randrange(1, 3)))), rng.randrange(1, 4)) for _ in range(3)]
        goal = [rng.randrange(0, 9) for _ in range(2)]
        taken = mixing.route(patterns, goal)

        def cost(amounts):
            return sum(sum(c * min(max(x - k * size, 0), size) for k, c in enumerate(mixing.COSTS))
                       for (_, size), x in zip(patterns, amounts))

        def served(amounts):
            best = 0
            for first in itertools.product(*[range(x + 1) if len(m) == 2 else [x if m == (0,) else 0]
                                             for (m, _), x in zip(patterns, amounts)]):
                second = [x - a for x, a in zip(amounts, first)]
                best = max(best, min(goal[0], sum(first)) + min(goal[1], sum(second)))
            return best

        ways = [w for w in itertools.product(*[range(3 * size + 1) for _, size in patterns])]
        most = max(map(served, ways))
        assert served(taken) == most == sum(taken)
        assert cost(taken) == min(cost(w) for w in ways if served(w) == most)


@pytest.fixture
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choices(["a", "b", "c", "é", None], [9, 2, 1, 2, 1])[0]
        rows.append((i, " ".join(["w"] * rng.choice([3, 10, 30, 400])), source, "x"))
    rows += [(2000, None, "a", "x"), (2001, " \n", "b", "x"), (None, "some words here", "a", "x"), (5000, "one two", "new", "x")]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, pattern string")


def test_a_mix_comes_near_its_targets(docs):
    size, sources = mixing.n_words(F.col("text")), F.array("source")
    sized = docs.select("doc_id", size.alias("size"), sources.alias("sources"))
    mix = mixing.plan_mix(sized)
    assert [n for n, _, _ in mix.sources] == ["a", "b", "c", "new", "é", None]
    taken = mixing.apply_mix(sized, mix).withColumn("source", F.col("sources")[0])
    assert taken.where("times > 3 or times < 0 or (size = 0 and times > 0)").isEmpty()
    got = {r["source"]: r["words"] for r in taken.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("words")).collect()}
    for name, whole, target in mix.sources:
        assert target <= 3 * whole
        assert abs(got[name] - target) <= max(20, 0.01 * target), name
    again = mixing.mixed(docs.repartition(7), size, sources)
    assert again.columns == docs.columns
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(again) == rows(mixing.mixed(docs, size, sources))
    assert rows(again) != rows(mixing.mixed(docs, size, sources, seed=1))


def chosen(rows, words, whole):
    """Ids that are taken once more than the others: (id, size) rows of one source of which ``words`` are taken."""
    unsigned = lambda i: xxhash.xxh64_intdigest(
        (0).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
    _, rest = divmod(words, whole)
    long_from = max(1, words // 200)
    taken, have = set(), 0

    def take(part, goal):
        sizes = {}
        for i, size in part:
            sizes[i] = sizes.get(i, 0) + size
        upto, ids, best = 0, [], (0, 0)
        for i in sorted(sizes, key=lambda i: (unsigned(i), i)):
            upto += sizes[i]
            ids.append(i)
            if 2 * upto - sizes[i] <= 2 * goal:
                best = (len(ids), upto)
        taken.update(ids[:best[0]])
        return best[1]

    long = [r for r in rows if r[1] > long_from]
    goal = rest * sum(size for _, size in long) // whole
    if rest and long and goal:
        have = take(long, goal)
    if rest > have:
        take([r for r in rows if 0 < r[1] <= long_from], rest - have)
    return taken


def test_the_choice_against_a_plain_loop(spark, docs):
    size, sources = mixing.n_words(F.col("text")), F.array("source")
    sized = docs.where("doc_id is not null").select("doc_id", size.alias("size"), sources.alias("sources"))
    rows = [(r["doc_id"], r["size"], r["sources"][0]) for r in sized.collect()]
    mix = mixing.plan_mix(sized)
    goal = {n: int(g) for n, _, g in mix.sources}
    got = {r["doc_id"]: r["times"] for r in mixing.apply_mix(sized, mix).collect()}
    for name, whole, _ in mix.sources:
        own = [(i, n) for i, n, s in rows if s == name]
        more = chosen(own, goal[name], whole)
        assert {i: got[i] for i, _ in own} == {i: min(3, goal[name] // whole + (i in more)) if n else 0 for i, n in own}, name


def test_clashing_columns(docs):
    names = ["pattern", "repeats", "times", "long_h", "short_all", "mix_h", "mix_id", "mix_size", "row", "long_from", "sources", "size"]
    more = docs.drop("pattern").withColumns({name: F.lit(f"own {name}") for name in names})
    size, sources = mixing.n_words(F.col("text")), F.array("source")
    got = mixing.mixed(more, size, sources)
    assert got.columns == more.columns
    assert got.select(names).distinct().collect() == [tuple(f"own {name}" for name in names)]
    ids = lambda d: sorted(map(str, d.select("doc_id").collect()))
    assert ids(got) == ids(mixing.mixed(docs, size, sources))


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x y", "a"), (3, "z", "b")], "doc_id long, text string, source string")
    got = mixing.mixed(docs, mixing.n_words(F.col("text")), F.array("source")).collect()
    assert {r["doc_id"] for r in got} >= {1} and max(len(r["text"]) for r in got) == 600_000


def test_documents_in_several_sources(spark):
    rows = [(k, 10, ["web"] if k % 3 else ["web", "book"]) for k in range(300)] + [(900, 10, ["book"]), (901, 10, [])]
    sized = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    mix = mixing.plan_mix(sized, lambda names: [1.0, 1.0])
    taken = mixing.apply_mix(sized, mix)
    by = {tuple(r["sources"]): r["words"] for r in taken.groupBy("sources").agg(F.sum(F.col("times") * F.col("size")).alias("words")).collect()}
    goals = {n: g for n, _, g in mix.sources}
    assert sum(by.values()) == pytest.approx(sum(goals.values()), rel=0.02)
    assert by["web",] == pytest.approx(goals["web"], rel=0.02) and by[()] == 0


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(docs, mixing.n_words(F.col("text")), F.array("source")).collect() == []
    blank = spark.createDataFrame([(1, "", "a")], docs.schema)
    assert mixing.mixed(blank, mixing.n_words(F.col("text")), F.array("source")).collect() == []
