"""Conversation structure repair: the cheapest edits, by Four-Russians block tables.

A conversation is well formed if its role initials are ``(s?(ua)+)?``.  Edits go over its
turns in order: Keep (cost 0), Rerole to user or assistant (2), Delete (3), Insert a turn of
either role with empty text (2).  Blank turns (no character outside ``[\\x20\\x09-\\x0D]``)
and duplicates (role and text stood in an earlier turn) must go; a truncated turn (its last
such character is none of ``.!?``) costs 1 more unless it goes.  Of equally cheap repairs the
one whose edits' initials are ASCII-least is taken.

1. A row becomes one of ten symbols: role (system, user, assistant, other) by truncated, must
   go, and one for nothing.
2. What is left to pay in each of the four states (nothing, s, u, a written last) is a vector;
   less its least entry there are few of them.  A table gives, for every vector and every
   block of ``BLOCK`` symbols after which it holds, the vector before and what it costs.
   Conversations are looked up block by block from their end.
3. Edits are traced from the start: a block is expanded backward into the vectors between its
   symbols, and in each state the least letter goes that pays no more than the vector says.
   Expansions are remembered by (block, vector after it, state).

Rows are sorted by (conversation, turn, role, text) over ranges, so one conversation may lie
in many tasks.  A task answers those that lie wholly inside; of its first and its last one it
gives the map of vectors and the map of states, which are composed for each conversation (one
row a task), then each part is traced where it is.  No task holds more than its range; equal
rows of one turn are counted before they are sorted, so ties can't make a range large.

Edge cases: null roles and texts are one space; a null conversation is one like others; null
turns come first and count in no gap.  Turns of one number stand by role, then text.  Equal
rows stand side by side, all but the first duplicates (or all blank).  A role counts by its
first letter: any that begins with none of s, u, a, empty ones too, must change or go.
Conversations of which nothing is left have an empty repair.  Very long texts are read whole.  An
empty table gives no rows.  Further columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, lean, small_batches, stash

BLOCK = 4
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
#: States: what was written last.
NOTHING, S, U, A = range(4)
#: State -> the state after the only turn of u or a that may follow.
THEN = (U, U, A, U)
#: (state, role) -> the state after that turn is kept.
KEPT = {(NOTHING, S - 1): S} | {(q, THEN[q] - 1): THEN[q] for q in range(4)}
OTHER = 3  # roles: 0, 1, 2 are s, u, a
#: Symbols: nothing, a turn that must go, 2 + 2 * role + truncated.
PAD, GO, SYMBOLS = 0, 1, 10
FAR = 1 << 20
ROLES = {U: "user", A: "assistant"}


def _moves(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a turn in a state."""
    moves = [("D", DELETE, state)]
    if symbol != GO:
        role, late = divmod(symbol - 2, 2)
        if (state, role) in KEPT:
            moves.append(("K", TRUNCATED * late, KEPT[state, role]))
        moves.append(("R", REROLE + TRUNCATED * late, THEN[state]))
    return moves


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[THEN[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """What is to pay before a turn, where ``after`` is to pay behind it."""
    if symbol == PAD:
        return after
    return _with_inserts([min(cost + after[to] for _, cost, to in _moves(q, symbol)) for q in range(4)])


END = _with_inserts([0, FAR, FAR, 0])


class Tables:
    """Vectors and blocks, as numbers."""

    def __init__(self) -> None:
        self.vectors, self.number = [END], {END: 0}
        one: list[list[tuple[int, int]]] = []  # vector -> symbol -> (vector before, cost)
        for v in self.vectors:  # grows meanwhile
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(v, symbol)
                less = tuple(c - min(costs) for c in costs)
                if less not in self.number:
                    self.number[less] = len(self.vectors)
                    self.vectors.append(less)
                row.append((self.number[less], min(costs)))
            one.append(row)
        step, paid = (np.array([[x[i] for x in row] for row in one], np.int32) for i in (0, 1))
        n = len(self.vectors)
        exits = np.array([[[self._symbol(s, v, q)[1] for q in range(4)] for v in range(n)] for s in range(SYMBOLS)], np.int32)
        #: (block, vector after it) -> vector before it, cost; (block, vector after it, state) -> state after it.
        self.before, self.cost = np.tile(np.arange(n, dtype=np.int32), (1, 1)), np.zeros((1, n), np.int32)
        self.exit = np.tile(np.arange(4, dtype=np.int32), (1, n, 1))
        for _ in range(BLOCK):  # one more symbol in front
            blocks = len(self.before)
            first = np.repeat(np.arange(SYMBOLS), blocks)[:, None]
            before, exit_ = np.tile(self.before, (SYMBOLS, 1)), np.tile(self.exit, (SYMBOLS, 1, 1))
            state = exits[first, before]  # after the first symbol
            self.exit = np.take_along_axis(exit_, state, axis=2)
            self.cost = np.tile(self.cost, (SYMBOLS, 1)) + paid[before, first]
            self.before = step[before, first]
        self.before_list, self.cost_list = self.before.tolist(), self.cost.tolist()
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _symbol(self, symbol: int, after: int, state: int) -> tuple[str, int]:
        """Letters up to and with a turn, and the state behind it."""
        behind = self.vectors[after]
        if symbol == PAD:
            return "", state
        costs, out = _before(behind, symbol), ""
        while True:
            options = [(letter, cost + behind[to], to) for letter, cost, to in _moves(state, symbol)]
            options.append(("I", INSERT + costs[THEN[state]], THEN[state]))
            letter, _, to = min(o for o in options if o[1] == costs[state])
            out += letter
            state = to
            if letter != "I":
                return out, state

    def trace(self, block: int, after: int, state: int) -> tuple[str, int]:
        """Letters of a block and the state behind it."""
        found = self.traced.get((block, after, state))
        if found is None:
            symbols = [block // SYMBOLS**i % SYMBOLS for i in reversed(range(BLOCK))]
            behind = [after]  # of each symbol, from the last to the first
            for s in reversed(symbols[1:]):
                costs = _before(self.vectors[behind[-1]], s)
                behind.append(self.number[tuple(c - min(costs) for c in costs)])
            letters, q = "", state
            for s, v in zip(symbols, reversed(behind), strict=True):
                more, q = self._symbol(s, v, q)
                letters += more
            found = self.traced[block, after, state] = letters, q
        return found

    @staticmethod
    def blocks(symbols: bytes) -> list[int]:
        padded = symbols + bytes(-len(symbols) % BLOCK)
        digits = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK).astype(np.int64)
        return (digits @ np.array([SYMBOLS**i for i in reversed(range(BLOCK))])).tolist()

    def solve(self, symbols: bytes, after: int = 0, state: int = NOTHING) -> tuple[int, str, int]:
        """Cost, letters and last state of a run of turns, behind which ``after`` is to pay; the
        cost is that of what follows too, less the least entry of ``after``."""
        blocks, behind, paid, v = self.blocks(symbols), [], 0, after
        for b in reversed(blocks):
            behind.append(v)
            paid += self.cost_list[b][v]
            v = self.before_list[b][v]
        paid += self.vectors[v][state]
        letters = []
        for b, v in zip(blocks, reversed(behind), strict=True):
            more, state = self.trace(b, v, state)
            letters.append(more)
        return paid, "".join(letters), state

    def maps(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a run: vector after it -> vector before it, and cost; (vector after it, state) -> state after it."""
        v, paid, states, behind = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64), np.tile(np.arange(4), (len(self.vectors), 1)), []
        blocks = self.blocks(symbols)
        for b in reversed(blocks):
            behind.append(v)
            paid, v = paid + self.cost[b][v], self.before[b][v]
        for b, after in zip(blocks, reversed(behind), strict=True):
            states = np.take_along_axis(self.exit[b][after], states, axis=1)
        return v, paid, states


@cache
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """Inserts at the end of a conversation."""
    return {NOTHING: "", S: "II", U: "I", A: ""}[state]


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def faults(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None) -> DataFrame:
    """(conv, turn, role, text, copies, fault): the different rows of each turn, how often they
    stand there, and the fault of the first.  ``copies``: a column that says how often a row
    stands for itself (0: its conversation is kept, without it)."""
    n = F.lit(1) if copies is None else F.col(f"`{copies}`")
    taken = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), _text(role).alias("role"), _text(text).alias("text"), n.cast("long").alias("copies"))
    once = taken.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    part = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    once = once.withColumn("key", F.sha2(F.concat(*(part(F.col(c).cast("string")) for c in ("conv", "turn", "role", "text"))), 256))
    once = stash(once, "turns")
    said = F.sha2(F.concat(part(F.col("role")), part(F.col("text"))), 256).alias("said")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("key").alias("key"))).alias("first")
    firsts = once.where("copies > 0").groupBy("conv", said).agg(first).select(F.col("first.key").alias("key"), F.lit(True).alias("new"))
    fault = (
        F.when(F.regexp_replace("text", SPACE, "") == "", "blank")
        .when(F.col("new").isNull(), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return once.join(firsts, "key", "left").select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


@dataclass
class Run:
    """The turns of one conversation in one task."""

    conv: object
    roles: list[str]
    texts: list[str]
    symbols: bytes
    counts: dict[str, object]


TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
COUNTS = ("turn_numbers", "blank", "duplicate", "truncated", "illegal")
EDGES = ("first_turn", "last_turn", "first_role", "last_role")
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Run, bool]]:
    """The runs of a task, each with whether it is the last."""
    held: list[tuple[object, ...]] = []
    conv, begun = None, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "fault")]
        for row in zip(*columns, strict=True):
            if begun and row[0] != conv:
                yield _run(conv, held), False
                held = []
            conv, begun = row[0], True
            held.append(row)
    if begun:
        yield _run(conv, held), True


def _run(conv: object, rows: list[tuple[object, ...]]) -> Run:
    roles, texts, symbols = [], [], bytearray()
    counts: dict[str, object] = dict.fromkeys(COUNTS, 0) | dict.fromkeys(EDGES)
    for _, turn, role, text, copies, fault in rows:
        if not copies:
            continue
        kind = "sua".find(role[:1]) if role else OTHER
        kind = OTHER if kind < 0 else kind
        must_go = fault in ("blank", "duplicate")
        symbols += bytes([GO if must_go else 2 + 2 * kind + (fault == "truncated")]) + bytes([GO]) * (copies - 1)
        roles += [role] * copies
        texts += [text] * copies
        if fault:
            counts[fault] += copies if must_go else 1
        if not must_go:
            counts["duplicate"] += copies - 1
        if counts["last_role"] is None:
            counts["first_role"] = kind
        elif (counts["last_role"], kind) not in LEGAL:
            counts["illegal"] += 1
        counts["illegal"] += copies - 1
        counts["last_role"] = kind
        if turn is not None and turn != counts["last_turn"]:
            counts["turn_numbers"] += 1
            counts["last_turn"] = turn
            counts["first_turn"] = turn if counts["first_turn"] is None else counts["first_turn"]
    return Run(conv, roles, texts, bytes(symbols), counts)


def _edited(run_roles: list[str], texts: list[str], letters: str, state: int) -> list[dict[str, str]]:
    """The turns that letters make of a run."""
    out, i = [], 0
    for letter in letters:
        if letter == "I":
            state = THEN[state]
            out.append({"role": ROLES[state], "text": ""})
            continue
        role, text = run_roles[i], texts[i]
        i += 1
        if letter == "K":
            state = KEPT[state, "sua".find(role[:1])]
            out.append({"role": role, "text": text})
        elif letter == "R":
            state = THEN[state]
            out.append({"role": ROLES[state], "text": text})
    return out


def _gaps(counts: dict[str, object]) -> int:
    return 0 if counts["first_turn"] is None else counts["last_turn"] - counts["first_turn"] + 1 - counts["turn_numbers"]


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What was wrong and what it became.

    The first frame has a row for each conversation: conv, gaps (numbers missing between its
    turns), blank, duplicate, truncated, illegal (neighbours that may not follow each other)
    and cost.  The second has the repaired turns: conv, part, parts, audit (the edits'
    initials) and turns (role, text); one part but for conversations that lie in several tasks."""
    kind = rows.schema[conv].dataType
    wrong = stash(faults(rows, conv, turn, role, text, copies), "faults")
    lead = F.substring("text", 1, 32)  # sorts as the text does; ranges are then cut between longer ties
    order = ["conv", "turn", "role", "text"]
    sorted_rows = small_batches(wrong).repartitionByRange("conv", "turn", "role", lead).sortWithinPartitions(*order)
    numbers = [*COUNTS, *EDGES]
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("conv", kind), T.StructField("task", T.LongType()), T.StructField("place", T.LongType()), T.StructField("whole", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in numbers]
        + [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("turns", turns)]
        + [T.StructField("symbols", T.BinaryType())]
        + [T.StructField(c, longs) for c in ("before", "paid", "exit")]
    )
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, t = TaskContext.get().partitionId(), tables()
        made: list[dict[str, object]] = []
        size = 0
        for place, (run, is_last) in enumerate(_runs(batches)):
            row = {"conv": run.conv, "task": task, "place": place, "whole": bool(place) and not is_last} | run.counts
            if row["whole"]:
                cost, letters, state = t.solve(run.symbols)
                letters += closing(state)
                row |= {"cost": cost, "audit": letters, "turns": _edited(run.roles, run.texts, letters, NOTHING)}
            else:  # parts of it may lie in the tasks next to this one
                before, paid, states = t.maps(run.symbols)
                row |= {"turns": [{"role": r, "text": x} for r, x in zip(run.roles, run.texts, strict=True)], "symbols": run.symbols}
                row |= {"before": before.tolist(), "paid": paid.tolist(), "exit": states.ravel().tolist()}
            made.append(row)
            size += sum(map(len, run.texts)) + len(run.symbols)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    runs = stash(sorted_rows.mapInArrow(lean(first_pass), schema), "runs")
    parts = runs.where("not whole")
    joined = stash(_composed(parts.select("conv", "task", "place", *numbers, "before", "paid", "exit"), kind), "composed")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                _, letters, state = t.solve(r["symbols"], r["after"], r["state"])
                letters += closing(state) if r["part"] == r["parts"] - 1 else ""
                roles, texts = [x["role"] for x in r["turns"]], [x["text"] for x in r["turns"]]
                made.append({"conv": r["conv"], "part": r["part"], "parts": r["parts"], "audit": letters, "turns": _edited(roles, texts, letters, r["state"])})
            yield pa.RecordBatch.from_pylist(made, schema=repaired_arrow)

    repaired_schema = T.StructType([T.StructField("conv", kind), T.StructField("part", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("turns", turns)])
    repaired_arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in repaired_schema])
    known = joined.select("task", "place", "part", "parts", "after", "state")  # two rows a task of the first pass
    split = parts.select("conv", "task", "place", "turns", "symbols").join(known, ["task", "place"]).mapInArrow(lean(second_pass), repaired_schema)
    whole = runs.where("whole")
    report = whole.select("conv", _gaps_column().alias("gaps"), *COUNTS[1:], "cost").unionByName(joined.where("part = 0").select("conv", "gaps", *COUNTS[1:], "cost"))
    repaired = whole.select("conv", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), "audit", "turns").unionByName(split)
    return report, repaired


def _gaps_column() -> Column:
    return F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turn_numbers"), F.lit(0).cast("long"))


def _composed(parts: DataFrame, kind: T.DataType) -> DataFrame:
    """(conv, task, place, part, parts, after, state, gaps, counts, cost) of the parts of each
    conversation: one a task at most, a few hundred numbers each."""
    fields = ["task", "place", "part", "parts", "after", "state", "gaps", *COUNTS[1:], "cost"]
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in fields)])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["task"], r["place"]))
        total = dict.fromkeys(COUNTS, 0) | dict.fromkeys(EDGES)
        for r in rows:
            for c in COUNTS:
                total[c] += r[c]
            if r["first_role"] is not None:
                if total["last_role"] is not None and (total["last_role"], r["first_role"]) not in LEGAL:
                    total["illegal"] += 1
                total["last_role"] = r["last_role"]
            if r["first_turn"] is not None:
                total["turn_numbers"] -= r["first_turn"] == total["last_turn"]
                total["first_turn"] = r["first_turn"] if total["first_turn"] is None else total["first_turn"]
                total["last_turn"] = r["last_turn"]
        v, cost = 0, 0
        for r in reversed(rows):
            r["after"] = v
            cost, v = cost + r["paid"][v], r["before"][v]
        cost += tables().vectors[v][NOTHING]
        state = NOTHING
        for i, r in enumerate(rows):
            r |= {"part": i, "parts": len(rows), "state": state, "gaps": _gaps(total), "cost": cost} | {c: total[c] for c in COUNTS[1:]}
            state = r["exit"][4 * r["after"] + state]
        return pa.Table.from_pylist([{c: r[c] for c in ("conv", *fields)} for r in rows], schema=arrow)

    return parts.groupBy("conv").applyInArrow(run, schema)


def digest(repaired: DataFrame) -> DataFrame:
    """(conv, audit, sha256): all edits of a conversation, and the hash of its repaired turns
    as ``role:text``, joined by newlines.  A hash runs over a text from its start to its end, so
    the parts of a conversation pass through one task one after the other; none is held."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = repaired.where("parts = 1").select("conv", "audit", F.sha2(lines.cast("binary"), 256).alias("sha256"))
    many = repaired.where("parts > 1").select("conv", "part", "audit", F.size("turns").alias("n"), lines.alias("lines"))
    schema = T.StructType([repaired.schema["conv"], T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType())])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, audit, running, begun, open_ = None, [], hashlib.sha256(), False, False
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if open_:
                        done.append({"conv": conv, "audit": "".join(audit), "sha256": running.hexdigest()})
                    conv, audit, running, begun, open_ = r["conv"], [], hashlib.sha256(), False, True
                audit.append(r["audit"])
                if r["n"]:
                    running.update((("\n" if begun else "") + r["lines"]).encode())
                    begun = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if open_:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "sha256": running.hexdigest()}], schema=arrow)

    return one.unionByName(many.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(lean(run), schema))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
