"""Mixing sources to target weights, as a minimum-cost flow.

A document may belong to several sources. Documents are first summed up by membership pattern (the set
of sources they belong to), so the flow has one node per pattern, not per document:

    start -> pattern: three parallel arcs, each as wide as the pattern's words, for using them a first,
                      second and third time; each repeat costs more than the one before (convex)
    pattern -> source: any amount, if the pattern has the source
    source -> end:     as wide as the source's target

The cheapest largest flow says how many words each pattern gives. What that is in whole repeats every
document of the pattern is taken for; the rest is filled with documents in the order of a seeded
hash of their ids. Finding where to stop needs no sort of a pattern: sums per hash range give the range
in which the limit lies, twice, and only rows of that last range are sorted. Long documents (over
half a percent of the pattern's words to take) are chosen before all others, so that the others can
make up for the error these leave.

The driver receives one row per pattern and per source, and the stops of each pattern.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name
from tidewatch.session import staged

LEVELS = 3
#: Cost of a word's first, second and third use.
COSTS = (1, 3, 7)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: list[str | None]) -> list[float]:
    """1, 2, 3, 1, 2, 3, ..."""
    return [float(k % 3 + 1) for k in range(len(sources))]


def targets(sizes: list[int], weights: list[float], most: float = LEVELS) -> list[float]:
    """All words shared by weight; no source above ``most`` times its size, the excess shared again."""
    goal = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                goal[k] = left * weights[k] / total
            break
        for k in over:
            goal[k] = float(most * sizes[k])
        left -= sum(goal[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return goal


@dataclass
class _Network:
    """Arcs as [to, room, cost]; arc k ^ 1 is the reverse of arc k."""

    nodes: int
    arcs: list[list[int]] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.out = [[] for _ in range(self.nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for start, end, wide, price in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.arcs))
            self.arcs.append([end, wide, price])
        return len(self.arcs) - 2

    def flow(self, start: int, end: int) -> None:
        """Push the largest flow at the least cost along cheapest paths, one after another."""
        height = [0] * self.nodes
        while True:
            far, by, queue = {start: 0}, {}, [(0, start)]
            while queue:
                d, node = heapq.heappop(queue)
                if d > far[node]:
                    continue
                for k in self.out[node]:
                    to, room, cost = self.arcs[k]
                    reach = d + cost + height[node] - height[to]
                    if room and reach < far.get(to, 1 << 60):
                        far[to], by[to] = reach, k
                        heapq.heappush(queue, (reach, to))
            if end not in far:
                return
            for node, d in far.items():
                height[node] += min(d, far[end])
            for node in range(self.nodes):
                if node not in far:
                    height[node] += far[end]
            path, node = [], end
            while node != start:
                path.append(by[node])
                node = self.arcs[by[node] ^ 1][0]
            push = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= push
                self.arcs[k ^ 1][1] += push


def route(patterns: list[tuple[tuple[int, ...], int]], goal: list[int]) -> list[int]:
    """Words to take from each pattern (members, words) so that sources reach their goals."""
    start, end = len(patterns) + len(goal), len(patterns) + len(goal) + 1
    net = _Network(end + 1)
    used = [[net.add(start, p, size, cost) for cost in COSTS] for p, (_, size) in enumerate(patterns)]
    for p, (members, size) in enumerate(patterns):
        for s in members:
            net.add(p, len(patterns) + s, LEVELS * size, 0)
    for s, words in enumerate(goal):
        net.add(len(patterns) + s, end, words, 0)
    net.flow(start, end)
    return [sum(net.arcs[k ^ 1][1] for k in arcs) for arcs in used]


def _key(members: Column) -> Column:
    """A pattern as text; names may hold any character, and null is a source."""
    name = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.concat_ws(",", F.transform(F.sort_array(F.array_distinct(members)), name))


_BITS = 12
#: A table made from the driver's rows is sent to all executors up to this many rows (some 10 MB).
BROADCAST_ROWS = 100_000


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has, as a table. Joined by broadcast if few, so that a pattern with very many
    documents isn't gathered in one task."""
    found = spark.createDataFrame(rows, schema)
    return F.broadcast(found) if len(rows) <= BROADCAST_ROWS else found


def _stops(rows: DataFrame, goals: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Per pattern the last (hash, id) to take in that order, and the words up to there.

    ``rows``: pattern, h, id, size. ``goals``: words wanted from each pattern. The words up to the stop
    are as near to the goal as a whole number of documents allows.
    """
    spark = rows.sparkSession
    before = dict.fromkeys(goals, 0)
    inside = {p: 0 for p in goals}
    wanted = rows
    for level in (1, 2):
        keep = listed(spark, [(p, before[p], inside[p], g) for p, g in goals.items()],
                       "pattern string, before long, inside long, goal long")
        shift = 64 - _BITS * level
        at = F.shiftrightunsigned("h", shift)
        wanted = rows.join(keep, "pattern").where(
            F.lit(True) if level == 1 else F.shiftrightunsigned("h", shift + _BITS) == F.col("inside"))
        ranges = wanted.groupBy("pattern", at.alias("at"), "before", "goal").agg(F.sum("size").alias("size"))
        upto = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("at"))
        found = (
            ranges.withColumn("upto", upto).where(F.col("upto") >= F.col("goal"))
            .groupBy("pattern").agg(F.min_by(F.struct("at", (F.col("upto") - F.col("size")).alias("b")), "at").alias("x"))
            .collect()
        )
        ends = {r["pattern"]: r["x"] for r in found}
        goals = {p: g for p, g in goals.items() if p in ends}
        for p in goals:
            inside[p], before[p] = ends[p]["at"], ends[p]["b"]
    if not goals:
        return {}
    keep = listed(spark, [(p, before[p], inside[p], g) for p, g in goals.items()],
                   "pattern string, before long, inside long, goal long")
    last = rows.join(keep, "pattern").where(F.shiftrightunsigned("h", 64 - 2 * _BITS) == F.col("inside"))
    # rows with the same id are taken or left together
    last = last.groupBy("pattern", "h", "id", "before", "goal").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("pattern").orderBy(F.shiftrightunsigned("h", 1), "h", "id")
    upto = F.col("before") + F.sum("size").over(order)
    fits = last.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("goal"))
    stop = F.max_by(F.struct("h", "id", "upto"), F.col("upto")).alias("x")
    stops = {r["pattern"]: (r["x"]["h"], r["x"]["id"], r["x"]["upto"])
             for r in fits.groupBy("pattern").agg(stop).collect()}
    for p in goals:
        # none of the last range: stop where it starts
        stops.setdefault(p, (_signed(inside[p] << (64 - 2 * _BITS)), None, before[p]))
    return stops


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


@dataclass
class Mix:
    """What ``plan_mix`` found; ``sources`` has (name, size, target) in the order of the weights."""

    sources: list[tuple[str | None, int, float]]
    plan: DataFrame


def plan_mix(sized: DataFrame, weigh: Callable[[list[str | None]], list[float]] = cyclic_weights,
             seed: int = 0) -> Mix:
    """Plan which documents of ``sized`` (doc_id, size, sources array) to take how often.

    ``weigh`` gives the sources' weights, for their names in code point order, null last.
    """
    spark = sized.sparkSession
    rows = staged(sized.select(_key(F.col("sources")).alias("pattern"), _hash(seed).alias("h"), _id().alias("id"),
                               F.col("size").cast("long").alias("size"),
                               F.array_distinct("sources").alias("members")))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()
    found = sorted((r for r in found if r["members"]), key=lambda r: r["pattern"])
    names = sorted({m for r in found for m in r["members"]}, key=lambda m: (m is None, m or ""))
    number = {name: k for k, name in enumerate(names)}
    patterns = [(tuple(sorted(number[m] for m in r["members"])), r["size"] or 0) for r in found]
    sizes = [0] * len(names)
    for members, size in patterns:
        for s in members:
            sizes[s] += size
    # a word in several sources can't fill all of them, so they share the words there are
    whole = sum(size for _, size in patterns)
    goal = targets(sizes, weigh(names)) if sum(sizes) == whole else _shared(sizes, weigh(names), whole)
    taken = route(patterns, [int(g) for g in goal])
    repeats, rest, long_from = {}, {}, {}
    for r, (_, size), words in zip(found, patterns, taken):
        p = r["pattern"]
        repeats[p], rest[p] = divmod(words, size) if size else (0, 0)
        long_from[p] = max(1, words // 200)
    limits = listed(spark, list(long_from.items()), "pattern string, long_from long")
    split = rows.where("size > 0").join(limits, "pattern").withColumn("long", F.col("size") > F.col("long_from"))
    totals = {(r["pattern"], r["long"]): r["size"]
              for r in split.groupBy("pattern", "long").agg(F.sum("size").alias("size")).collect()}
    size_of = {r["pattern"]: size for r, (_, size) in zip(found, patterns)}
    big = {p: x * totals[p, True] // size_of[p] for p, x in rest.items() if x and (p, True) in totals}
    long_stops = _stops(split.where("long").select("pattern", "h", "id", "size"), big) if big else {}
    have = {p: long_stops[p][2] if p in long_stops else 0 for p in rest}
    small = {p: x - have[p] for p, x in rest.items() if x > have[p] and (p, False) in totals}
    short_stops = _stops(split.where("not long").select("pattern", "h", "id", "size"), small) if small else {}
    lines = []
    for r in found:
        p = r["pattern"]
        stops = []
        for kind, goals, stop in ((True, big, long_stops.get(p)), (False, small, short_stops.get(p))):
            if p in goals and stop is None:  # all of them together are below the goal
                stops += [True, None, None]
            else:
                stops += [False, *(stop[:2] if stop else (None, None))]
        lines.append((p, repeats[p], long_from[p], *stops))
    kinds = ", ".join(f"{k}_all boolean, {k}_h long, {k}_id long" for k in ("long", "short"))
    plan = listed(spark, lines, f"pattern string, repeats long, long_from long, {kinds}")
    return Mix([(n, s, g) for n, s, g in zip(names, sizes, goal)], plan)


def _shared(sizes: list[int], weights: list[float], whole: int) -> list[float]:
    """Targets of overlapping sources: the words there are, by weight, under the same limits."""
    scale = whole / sum(sizes) if sum(sizes) else 0.0
    return [scale * g for g in targets(sizes, weights, LEVELS / scale if scale else LEVELS)]


def _hash(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _upto(kind: str, names: dict[str, str]) -> Column:
    """True for rows not after the stop, in the unsigned order of hashes."""
    of = lambda name: F.col(names[name])
    high, stop = F.shiftrightunsigned(of("h"), 1), F.shiftrightunsigned(of(f"{kind}_h"), 1)
    low, stop_low = of("h").bitwiseAND(F.lit(1)), of(f"{kind}_h").bitwiseAND(F.lit(1))
    same = (of("h") == of(f"{kind}_h")) & (of("id") <= of(f"{kind}_id"))
    before = (high < stop) | ((high == stop) & (low < stop_low)) | same
    return F.coalesce(of(f"{kind}_all") | before, F.lit(False))


def apply_mix(docs: DataFrame, mix: Mix, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, size, sources and more) with ``times``: how often each is taken.

    A column ``times`` of their own is replaced; other names can't clash.
    """
    names = {c: free_name(docs.columns, f"mix_{c}") for c in ("h", "id", "key", *mix.plan.columns)}
    rows = docs.withColumns({names["key"]: _key(F.col("sources")), names["h"]: _hash(seed), names["id"]: _id()})
    plan = mix.plan.withColumnsRenamed({c: names[c] for c in mix.plan.columns})
    joined = rows.join(plan, F.col(names["key"]) == F.col(names["pattern"]), "left")
    upto = F.when(F.col("size") > F.col(names["long_from"]), _upto("long", names)).otherwise(_upto("short", names))
    times = F.when(F.col("size") > 0, F.coalesce(F.col(names["repeats"]) + upto.cast("long"), F.lit(0))).otherwise(0)
    kept = [c for c in docs.columns if c != "times"]
    return joined.select(*kept, F.least(times, F.lit(LEVELS)).cast("long").alias("times"))


def mixed(docs: DataFrame, size: Column, sources: Column, seed: int = 0,
          weigh: Callable[[list[str | None]], list[float]] = cyclic_weights) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they were.

    ``size`` and ``sources`` (an array) are computed from the rows. A null id hashes like any other; rows with
    equal ids are taken alike; a text without words is not taken; no rows give none.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", size.alias("size"), sources.alias("sources"))
    mix = plan_mix(staged(rows.drop("row")), weigh, seed)
    taken = apply_mix(rows, mix, seed).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
