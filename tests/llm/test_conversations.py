"""Conversation repair against trying all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import conversations as c
from tidewatch.llm import queries

GRAMMAR = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(SPACES)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "fine" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, repaired rows) of all repairs with at most four inserts."""
    kinds = faults(rows)
    choices = []
    for (role, text), kind in zip(rows, kinds):
        own = [(3, "D", None)]
        if kind not in ("blank", "duplicate"):
            extra = kind == "truncated"
            own += [(extra, "K", (role, text))] + [(2 + extra, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    for edits in itertools.product(*choices):
        base = [e[2] for e in edits]
        for inserts in range(5):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
                for roles in itertools.product(("user", "assistant"), repeat=inserts):
                    audit, out = "", []
                    for k in range(len(rows) + 1):
                        for at, role in zip(places, roles):
                            if at == k:
                                audit += "I"
                                out.append((role, ""))
                        if k < len(rows):
                            audit += edits[k][1]
                            out += [base[k]] if base[k] else []
                    if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                        yield sum(e[0] for e in edits) + 2 * inserts, audit, out


def least_cost(rows):
    """The least cost, for longer conversations: row by row forward, per last initial."""
    after = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}
    costs = {"": 0}

    def with_inserts(costs):
        for _ in range(3):
            for state, cost in list(costs.items()):
                for to in set(after[state]) - {"s"}:
                    costs[to] = min(costs.get(to, 99999), cost + 2)
        return costs

    for (role, _), kind in zip(rows, faults(rows)):
        new = {}
        for state, cost in with_inserts(costs).items():
            ways = [(state, 3)]
            if kind not in ("blank", "duplicate"):
                ways += [(to, (0 if role[:1] == to else 2) + (kind == "truncated")) for to in after[state] if role[:1] == to or to != "s"]
            for to, more in ways:
                new[to] = min(new.get(to, 99999), cost + more)
        costs = new
    return min(v for k, v in with_inserts(costs).items() if k in ("", "a"))


def symbols_of(rows):
    return "".join(c.SYMBOLS[kind]["suax".index(r[:1] if r[:1] in ("s", "u", "a") else "x")] for (r, _), kind in zip(rows, faults(rows)))


def repaired(rows):
    """What the operator makes of rows, by its own parts."""
    signature = symbols_of(rows)
    [(_, cost, audit)] = c.solve([signature])
    (state, edits), (tail_state, tail) = c.dealt(signature, audit, [len(rows)])
    run, out = c._Run(state, edits), []
    for row in rows:
        out += run.row(*row)
    return cost, audit, out + list(c._Run(tail_state, tail).inserts())


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " ", "", "agent"]), st.sampled_from(["x.", "y!", "cut", "", " \t"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_against_all_repairs(rows):
    cost, audit, out = min(every_repair(rows))
    assert repaired(rows) == (cost, audit, out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROW, st.integers(0, 10**6)), max_size=14))
def test_longer_against_forward_search(rows):
    rows = [(role, f"{n}{text}" if text.strip() and n % 3 else text) for (role, text), n in rows]
    got = repaired(rows)
    assert got[0] == least_cost(rows)
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in got[2]))


def test_shared_suffixes_give_the_same():
    rng = random.Random(4)
    many = sorted({"".join(rng.choices("suaxSUAX0167", k=rng.randrange(0, 9))) for _ in range(3000)}, key=lambda s: s[::-1])
    for (signature, cost, audit) in c.solve(many):
        assert [(signature, cost, audit)] == list(c.solve([signature]))


def test_nodes_are_built_once(monkeypatch):
    built, node = [], c._node
    monkeypatch.setattr(c, "_node", lambda symbol, after: built.append(1) or node(symbol, after))
    many = sorted(["sua", "ua", "xua", "ssua", "uaa"], key=lambda s: s[::-1])
    assert len(list(c.solve(many))) == 5
    assert len(built) == len({s[k:] for s in many for k in range(len(s))})


# --- tables ---------------------------------------------------------------------------------------


def by_hand(rows):
    """The query's rows, one conversation after another."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        plain = [r[1:] for r in own]
        kinds, initials = faults(plain), [r[:1] for r, _ in plain]
        cost, audit, fixed = repaired(plain)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(60), None, -7]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "Assistant"])
            text = rng.choice(["Yes.", "No!", "cut off", None, "", " \n\t", "漢字。", "Same.", "a\nb? ", "x" * 200_000 + ".", "ends. "])
            rows += [(conv, rng.choice([turn, turn, turn, None]), role, text)] * rng.choice([1, 1, 1, 2])
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    rows += [(901, 5, "user", "same row.")] * 2000
    table = [(*r, "clash", 1, "x") for r in rows]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, audit string, place long, part string")
    assert got(c.damaged_and_repaired(df.repartition(5))) == by_hand(rows)


def test_dropped_conversations(spark):
    dropped = next(k for k in itertools.count() if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert got(c.damaged_and_repaired(df)) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(c.damaged_and_repaired(df.limit(0))) == []


def test_one_long_conversation_over_many_ranges(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}." if t % 7 else "t") for t in range(2000)] + [(1, 2000, "user", "Last.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fixed = c.repair(df)
        assert c.placed(df).select("part").distinct().count() > 1
        cost, audit, out = repaired([r[2:] for r in rows])
        report = fixed.report.collect()[0]
        assert (report["cost"], report["audit"]) == (cost, audit)
        assert [(r["role"], r["text"]) for r in fixed.rows.orderBy("position").collect()] == out
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(queries.op13_conversation_repair(spark, tables)) == by_hand(map(tuple, rows))


@pytest.mark.parametrize("rows, audit, cost", [
    ([], "", 0),
    ([("user", "Hi."), ("assistant", "Yes.")], "KK", 0),
    ([("user", "Hi.")], "KI", 2),
    ([("system", "Be.")], "D", 3),
    ([("user", "Hi."), ("assistant", "Yes"), ("user", "")], "KKD", 4),
])
def test_examples(rows, audit, cost):
    assert repaired(rows)[:2] == (cost, audit)
