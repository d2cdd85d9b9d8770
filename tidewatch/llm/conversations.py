"""Repair of conversation structure by an automaton over suffixes.

A conversation is to have the roles ``(s?(ua)+)?`` by their initials: perhaps a system row, then user and assistant in turn.
Each row has a symbol, its initial and its fault; a conversation's symbols in order are its signature. The cheapest
edits of a row depend on what follows it and on the grammar's state before it, and on nothing else. So signatures
are read from their ends: those that end alike share the nodes of an automaton, one per distinct suffix, and a node
holds, for each state, the cost from there on and its first edit with the node and state where that leads.
An audit is read off by following these links. Edits have different letters and lead to one place each, so that
among equally cheap audits the least by its letters starts with the least letter, and no audits are compared.

Distinct signatures are range-partitioned and sorted by their reversal. Then all that share a suffix follow each
other, every node is built once (again only where a range begins), and only the nodes of the current signature are held.

Rows are placed by one range partitioning, which also spreads a conversation of many rows over tasks; its
signature is put together from one piece per range. Signature and audit have a character a row, as the result has. Texts
meet their edits again in one shuffle by conversation, sorted, and are read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices
from tidewatch.session import staged

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "turn", "role", "text")
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1

#: Symbols by initial (system, user, assistant, other) and fault.
SYMBOLS = {"fine": "suax", "truncated": "SUAX", "blank": "0123", "duplicate": "4567"}
_INITIAL = {symbol: "suax"[k] for row in SYMBOLS.values() for k, symbol in enumerate(row)}
_TRUNCATED = frozenset(SYMBOLS["truncated"])
_DELETED = frozenset(SYMBOLS["blank"] + SYMBOLS["duplicate"])

#: States of the grammar: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Where a new or renamed row leads, and its role: the grammar leaves one choice in each state.
_FORCED = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
_LEGAL = frozenset(("su", "ua", "au"))


# --- the automaton --------------------------------------------------------------------------------


def _node(symbol: str | None, after: tuple | None) -> tuple:
    """The node of a suffix: per state (cost, edit, next node or None for this one, next state).

    ``after`` is the node of what follows ``symbol``; both are None for the empty suffix.
    """
    best: list[tuple | None] = []
    for state in STATES:
        choices = []
        if symbol is None:
            if state in (START, ASSISTANT):
                choices.append((0, "", None, state))
        else:
            choices.append((DELETE + after[state][0], "D", after, state))
            if symbol not in _DELETED:
                extra = TRUNCATED * (symbol in _TRUNCATED)
                kept = _MOVES[state].get(_INITIAL[symbol])
                if kept is not None:
                    choices.append((extra + after[kept][0], "K", after, kept))
                choices.append((REROLE + extra + after[_FORCED[state]][0], "R", after, _FORCED[state]))
        best.append(min(choices, key=lambda c: c[:2], default=None))
    own = list(best)
    for _ in range(3):  # more inserts in a row come back to a state that was left
        for state in STATES:
            there = own[_FORCED[state]]
            if there is not None:
                insert = (INSERT + there[0], "I", None, _FORCED[state])
                if own[state] is None or insert[:2] < own[state][:2]:
                    own[state] = insert
    return tuple(own)


_END = _node(None, None)


def _audit(node: tuple) -> tuple[int, str]:
    """Cost and edits of a whole signature."""
    letters, state, cost = [], START, node[START][0]
    while node[state][1]:
        _, letter, after, state = node[state]
        letters.append(letter)
        node = node if after is None else after
    return cost, "".join(letters)


def solve(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of each; nodes are shared between neighbours that end alike."""
    path, before = [_END], ""  # path[k] is the node of the last k symbols
    for signature in signatures:
        shared, most = 0, min(len(signature), len(before))
        while shared < most and signature[-1 - shared] == before[-1 - shared]:
            shared += 1
        del path[shared + 1:]
        for symbol in reversed(signature[:len(signature) - shared]):
            path.append(_node(symbol, path[-1]))
        before = signature
        yield signature, *_audit(path[-1])


def illegal_pairs(signature: str) -> int:
    initials = [_INITIAL[symbol] for symbol in signature]
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        names = ("signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        kinds = (pa.string(), *[pa.int64()] * 5, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], list(names))

    for signature, cost, audit in solve(s for batch in batches for s in batch.column(0).to_pylist()):
        counts = [sum(map(signature.count, SYMBOLS[fault])) for fault in ("blank", "duplicate", "truncated")]
        held.append((signature, *counts, illegal_pairs(signature), cost, audit))
        size += len(signature)
        if len(held) >= 1024 or size > 1 << 22:
            yield out()
            held.clear()
            size = 0
    if held:
        yield out()


def solved_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of the distinct rows of ``signatures``."""
    reverse = F.reverse("signature")
    rows = signatures.select("signature").distinct()
    # The bounds of ranges come from a sample on the driver, so they have the last 256 symbols only.
    ranged = rows.repartitionByRange(F.left(reverse, F.lit(256)), F.xxhash64("signature")).sortWithinPartitions(reverse)
    return ranged.mapInArrow(
        _solve_batches, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# --- rows -----------------------------------------------------------------------------------------


def _visible(text: Column) -> Column:
    """Without white space at its end."""
    return F.rtrim(text, F.lit(SPACES))


def placed(rows: DataFrame) -> DataFrame:
    """Written rows with ``place``, which grows along each conversation, ``part`` (its range) and ``fault`` but for duplicates.

    Rows are ordered by turn (nulls first), then by role and text (the first 64 characters of each, then a hash).
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    named = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = {
        "order_role": F.left("role", F.lit(64)),
        "order_text": F.left("text", F.lit(64)),
        "order_hash": F.xxhash64("role", "text"),
        "order_tie": F.monotonically_increasing_id(),  # deals equal rows out
    }
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", *order)]
    ranged = named.withColumns(order).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*order)
    end = _visible(F.col("text"))
    fault = F.when(end == "", "blank").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "fine").otherwise("truncated")
    place = F.monotonically_increasing_id()
    return staged(ranged.withColumns({"place": place, "part": F.shiftright(place, 33), "fault": fault}))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, part, place, symbol) of placed rows. A row whose role and text stand earlier is a duplicate."""
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    light = rows.select("conv_id", "part", "place", "fault", F.left("role", F.lit(1)).alias("initial"), content.alias("content"))
    # One row per content that occurs again; counted before the shuffle, however often one occurs.
    again = light.where("fault <> 'blank'").groupBy("conv_id", "content").agg(
        F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv_id").alias("again_conv"), F.col("content").alias("again_content"), "first")
    joined = light.join(staged(again), _same("conv_id", "again_conv") & _same("content", "again_content"), "left")
    fault = F.when((F.col("fault") != "blank") & (F.col("place") > F.col("first")), "duplicate").otherwise(F.col("fault"))
    at = F.when(F.col("initial").isin("s", "u", "a"), F.expr("instr('sua', initial)")).otherwise(4)
    table = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    return joined.select("conv_id", "part", "place", F.substr(table[fault], at, F.lit(1)).alias("symbol"))


def signatures(marked: DataFrame) -> DataFrame:
    """(conv_id, signature, parts) of rows (conv_id, part, place, symbol); ``parts`` has (part, number of rows) in order."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda r: r["symbol"]), "")
    pieces = marked.groupBy("conv_id", "part").agg(piece.alias("piece"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    return whole.select(
        "conv_id", F.array_join(F.col("pieces.piece"), "").alias("signature"),
        F.transform("pieces", lambda p: F.struct(p["part"].alias("part"), F.length(p["piece"]).alias("rows"))).alias("parts"))


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns missing between the least and the largest."""
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("turns"))
    gaps = F.col("most").cast("long") - F.col("least").cast("long") + 1 - F.col("turns")
    return turns.select("conv_id", F.coalesce(gaps, F.lit(0)).alias("gaps"))


# --- edits ----------------------------------------------------------------------------------------


#: Places of edits among the rows of their run: all but inserts at the conversation's end go first.
BEFORE, AFTER = -1, (1 << 63) - 1


def dealt(signature: str, audit: str, sizes: Iterable[int]) -> Iterator[tuple[int, str]]:
    """(state before, edits) for runs of so many rows, and then for inserts at the end."""
    at = row = 0
    state = START
    for size in sizes:
        start, before, end = at, state, row + size
        while row < end:
            letter = audit[at]
            at += 1
            if letter == "K":
                state = _MOVES[state][_INITIAL[signature[row]]]
            elif letter != "D":
                state = _FORCED[state]
            row += letter != "I"
        yield before, audit[start:at]
    yield state, audit[at:]


def _deal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (conv_id, signature, audit, parts) as edits of each run of rows."""
    for batch in slices(batches, 256):
        found = []
        for k, (signature, audit, runs) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            places = [*((run["part"], BEFORE) for run in runs), (runs[-1]["part"], AFTER)]
            edits = dealt(signature, audit, [run["rows"] for run in runs])
            found += [(k, *place, *edit) for place, edit in zip(places, edits) if edit[1]]
        index, parts, places, states, letters = zip(*found) if found else [()] * 5
        yield pa.RecordBatch.from_pydict({
            "conv_id": batch.column(0).take(pa.array(index, pa.int64())),
            "part": pa.array(parts, pa.int64()),
            "place": pa.array(places, pa.int64()),
            "state": pa.array(states, pa.int32()),
            "edits": pa.array(letters, pa.string()),
        })


class _Run:
    """A run of rows and its edits."""

    def __init__(self, state: int, edits: str):
        self.state, self.edits, self.at = state, edits, 0

    def _forced(self) -> str:
        role, self.state = _ROLE[self.state], _FORCED[self.state]
        return role

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._forced(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.edits[self.at]
        self.at += 1
        if letter == "K":
            self.state = _MOVES[self.state][role[:1]]
            yield role, text
        elif letter == "R":
            yield self._forced(), text


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and edits (conv_id, place, role, text, state, edits) of each conversation in order, as repaired rows."""
    run, conv, position = None, object(), 0
    for batch in slices(batches, 256):
        found = []
        for k, (own, place, role, text, state, edits) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if own != conv:
                conv, position = own, 0
            if edits is not None:
                run = _Run(state, edits)
            rows = run.row(role, text) if edits is None else run.inserts() if place == AFTER else ()
            for new in rows:
                position += 1
                found.append((k, position, *new))
        index, positions, roles, texts = zip(*found) if found else [()] * 4
        yield pa.RecordBatch.from_pydict({
            "conv_id": batch.column(0).take(pa.array(index, pa.int64())),
            "position": pa.array(positions, pa.int64()),
            "role": pa.array(roles, pa.string()),
            "text": pa.array(texts, pa.string()),
        })


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows (conv_id, position, role, text), as they come, to one hash per conversation."""
    conv = kind = hasher = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array([conv], kind), "repaired_sha256": pa.array([hasher.hexdigest()], pa.string())})

    for batch in batches:
        kind = batch.schema.field(0).type
        for own, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if position == 1:
                if hasher is not None:
                    yield out()
                conv, hasher = own, hashlib.sha256()
            hasher.update(f"{chr(10) * (position > 1)}{role}:{text}".encode())
    if hasher is not None:
        yield out()


@dataclass
class Repair:
    """``report``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows.
    ``rows``: the repaired rows as (conv_id, position from 1, role, text), each conversation's in order in one partition."""

    report: DataFrame
    rows: DataFrame

    def hashes(self) -> DataFrame:
        """(conv_id, repaired_sha256): of the repaired rows as ``role:text``, joined by newlines."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        return self.rows.mapInArrow(_hash_batches, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> Repair:
    """Judge and repair rows (conv_id, turn, role, text).

    Null roles and texts are one space. A null conversation is one of its own; null turns come first; equal rows are all kept, the
    later ones as duplicates; other columns are ignored, whatever their names; no rows give no conversations. A
    conversation may have any number of rows: a task holds a range of them, or one character for each.
    """
    rows = placed(conversations)
    marked = staged(signatures(symbols(rows)))
    solved = staged(solved_signatures(marked))
    known = staged(marked.join(solved, "signature"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    edits = known.select("conv_id", "signature", "audit", "parts").mapInArrow(
        _deal_batches, f"conv_id {kind}, part long, place long, state int, edits string")
    texts = rows.select("conv_id", "part", "place", "role", "text")
    together = texts.unionByName(edits, allowMissingColumns=True)
    ordered = together.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    repaired = ordered.select("conv_id", "place", "role", "text", "state", "edits").mapInArrow(
        _edit_batches, f"conv_id {kind}, position long, role string, text string")
    counts = known.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    gaps = turn_gaps(rows).withColumnRenamed("conv_id", "gaps_conv")
    report = counts.join(gaps, _same("conv_id", "gaps_conv")).drop("gaps_conv")
    return Repair(report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired)


# --- damage for trials ----------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role ``user``. Nulls of
    the key, of role and of text are one space.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in COLUMNS]
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(key[3], ".!?", "")).otherwise(key[3])
    role = F.when(fault == 4, "user").otherwise(key[2])
    times = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return conversations.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


EMPTY_SHA256 = hashlib.sha256().hexdigest()


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Each conversation's damage, the report on it and the hash of what repair makes of it.

    Conversations without rows after the damage have zeros, an empty audit and the hash of nothing.
    """
    found = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").alias("own")).distinct()
    report = ids.join(found.report, _same("own", "conv_id"), "left").drop("conv_id")
    joined = report.join(found.hashes(), _same("own", "conv_id"), "left").drop("conv_id").withColumnRenamed("own", "conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
