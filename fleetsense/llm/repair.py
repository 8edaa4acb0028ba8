"""Conversation structure repair: the cheapest edits that bring a conversation into turn order, by a streaming Viterbi.

Rows of a conversation stand by turn (nulls first), then role and text. A row's first fault counts: blank (no character
but white space), duplicate (role and text stood earlier), truncated (the last character that is not white space is none
of `.!?`). Edits are K(eep) at 0, R(erole to user or assistant) at 1, D(elete) at 2, I(nsert an empty user or assistant
turn) at 5; an undeleted truncated row adds 5; blank and duplicate rows must go. Roles that remain start with
`(s?(ua)+)?`. Of equally cheap edits the ones whose letters are least in ASCII win.

Four states are enough (nothing yet, after system, after user, after assistant), each with one survivor: the cheapest
way to it. Survivors are leaves of a backpointer tree whose nodes count their references. A node that no survivor needs
is freed; once all survivors share an ancestor, the edits above it are given out and their rows forgotten. Ties compare
the whole unresolved suffixes: the fork of two survivors decides, and is remembered. A survivor is dropped when another one could
imitate it for less, so memory holds the unresolved edits only, however long the conversation.

One shuffle by conversation; rows stream through a task in sorted order and are never gathered. A conversation is
sequential by nature, so it stays in one task; blank and truncated are found before the shuffle.

Null roles and texts count as one space. Null turns are left out of gaps. Rows with a null conv_id are one conversation.
Equal rows are ties that change nothing. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)                        # state that an insert or a rerole leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What state s pays at most to do from then on what state t could: insert a turn, or delete a system turn that t keeps.
IMITATE = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
RIGHT, BLANK, DUPLICATE, TRUNCATED = range(4)
REPORT = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


class Survivors:
    """The survivors of one conversation; edit(letter) is called for every edit once no survivor disagrees."""

    def __init__(self, edit: Callable[[str], None]) -> None:
        self.edit = edit
        self.parent, self.letter, self.refs, self.kids, self.depth = [-1], [""], [1], [0], [0]
        self.free: list[int] = []
        self.root = 0
        self.cost, self.node = {EMPTY: 0}, {EMPTY: 0}
        self.forks: dict[tuple[int, int], tuple[str, str]] = {}    # (s, t): the first edits in which s and t differ

    def grow(self, parent: int, letter: str) -> int:
        if self.free:
            x = self.free.pop()
            self.parent[x], self.letter[x], self.refs[x], self.kids[x], self.depth[x] = parent, letter, 1, 0, self.depth[parent] + 1
        else:
            x = len(self.parent)
            for column, value in ((self.parent, parent), (self.letter, letter), (self.refs, 1), (self.kids, 0), (self.depth, self.depth[parent] + 1)):
                column.append(value)
        self.refs[parent] += 1
        self.kids[parent] ^= x
        return x

    def release(self, x: int) -> None:
        self.refs[x] -= 1
        while not self.refs[x] and x != self.root:
            up = self.parent[x]
            self.free.append(x)
            self.kids[up] ^= x
            self.refs[up] -= 1
            x = up

    def fork(self, s: int, t: int) -> tuple[str, str]:
        """The edits of two survivors right after their last common node, "" for one that ends there."""
        if (s, t) not in self.forks:
            x, y, a, b = self.node[s], self.node[t], "", ""
            while x != y:
                if self.depth[x] >= self.depth[y]:
                    a, x = self.letter[x], self.parent[x]
                else:
                    b, y = self.letter[y], self.parent[y]
            self.forks[s, t], self.forks[t, s] = (a, b), (b, a)
        return self.forks[s, t]

    def extended(self, s: int, letter: str, t: int, other: str) -> tuple[str, str]:
        """The fork of survivor s and one more edit from survivor t and another one."""
        if s == t:
            return letter, other
        a, b = self.fork(s, t)
        return a or letter, b or other

    def insert(self) -> None:
        """Let every state be reached by inserted turns too."""
        for _ in range(3):
            changed = False
            for s in list(self.cost):
                t, cost = NEXT[s], self.cost[s] + 5
                if t in self.cost:
                    if cost > self.cost[t]:
                        continue
                    a, b = self.extended(s, "I", t, "")
                    if cost == self.cost[t] and a > b:
                        continue
                forks = {o: self.extended(s, "I", o, "") for o in self.cost if o != t}
                x = self.grow(self.node[s], "I")
                if t in self.node:
                    self.release(self.node[t])
                self.cost[t], self.node[t], changed = cost, x, True
                for o, (a, b) in forks.items():
                    self.forks[t, o], self.forks[o, t] = (a, b), (b, a)
            if not changed:
                return

    def consume(self, initial: str, fault: int) -> None:
        """Take one more row."""
        self.insert()
        best: dict[int, tuple[int, int, str]] = {}
        keeps = KEEPS.get(initial, {})
        for s, cost in self.cost.items():
            moves = [(s, cost + 2, "D")]
            if fault in (RIGHT, TRUNCATED):
                more = 5 * (fault == TRUNCATED)
                moves.append((NEXT[s], cost + 1 + more, "R"))
                if s in keeps:
                    moves.append((keeps[s], cost + more, "K"))
            for t, price, letter in moves:
                if t in best:
                    old, r, other = best[t]
                    if price > old:
                        continue
                    if price == old:
                        a, b = self.extended(s, letter, r, other)
                        if a > b:
                            continue
                best[t] = (price, s, letter)
        best = {t: x for t, x in best.items() if not any(best[o][0] + IMITATE[o][t] < x[0] for o in best if o != t)}
        forks = {(t, o): self.extended(s, letter, r, other) for t, (_, s, letter) in best.items() for o, (_, r, other) in best.items() if t != o}
        node = {t: self.grow(self.node[s], letter) for t, (_, s, letter) in best.items()}
        for x in self.node.values():
            self.release(x)
        self.cost, self.node, self.forks = {t: x[0] for t, x in best.items()}, node, forks
        self.settle()

    def settle(self) -> None:
        """Give out the edits that all survivors share."""
        alive = set(self.node.values())
        while self.refs[self.root] == 1 and self.root not in alive:
            old, self.root = self.root, self.kids[self.root]
            self.free.append(old)
            self.edit(self.letter[self.root])

    def finish(self) -> int:
        """Give out the remaining edits of the cheapest end; its cost."""
        self.insert()
        ends = [s for s in (EMPTY, ASSISTANT) if s in self.cost]
        s = min(ends, key=lambda s: self.cost[s])
        if len(ends) == 2 and self.cost[EMPTY] == self.cost[ASSISTANT]:
            a, b = self.fork(EMPTY, ASSISTANT)
            s = EMPTY if a < b else ASSISTANT
        rest, x = [], self.node[s]
        while x != self.root:
            rest.append(self.letter[x])
            x = self.parent[x]
        for letter in reversed(rest):
            self.edit(letter)
        return self.cost[s]


class Repair:
    """One conversation: counts its faults, and turns edits into turns as soon as they are certain."""

    def __init__(self, turn: Callable[[str, str | None, str | None], None]) -> None:
        self.turn, self.state, self.waiting = turn, EMPTY, deque()
        self.survivors = Survivors(self.edited)
        self.faults = [0, 0, 0, 0]
        self.rows = self.illegal = self.numbers = 0
        self.first = self.last = self.initial = None

    def add(self, number: int | None, role: str, text: str, fault: int) -> None:
        if number is not None:
            self.first = number if self.first is None else self.first
            self.numbers += number != self.last
            self.last = number
        initial = role[:1]
        self.illegal += self.rows > 0 and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.rows += 1
        self.faults[fault] += 1
        self.waiting.append((role, text))
        self.survivors.consume(initial, fault)

    def edited(self, letter: str) -> None:
        role, text = ("", "") if letter == "I" else self.waiting.popleft()
        if letter == "D":
            self.turn(letter, None, None)
            return
        if letter == "K":
            self.state = KEEPS[role[:1]][self.state]
        else:
            self.state = NEXT[self.state]
            role = NAMES[self.state]
        self.turn(letter, role, text)

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.numbers


def ordered(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, fault, present: sorted by conversation and place inside partitions."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                       (F.lit(True) if present is None else present).alias("present"))
    own = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(RIGHT)
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("own", own).withColumn("same", same).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "same").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("nth") > 1, DUPLICATE).otherwise(F.col("own"))
    rows = rows.withColumn("nth", nth).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "present")


def conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[int | None], Repair]) -> Iterator[tuple[int | None, Repair] | None]:
    """Feed sorted rows to one Repair per conversation; (conv_id, repair) at its end, None after each batch."""
    now, repair = None, None
    for batch in batches:
        for conv, turn, role, text, fault, present in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    yield now, repair
                now, repair = conv, begin(conv)
            if present:
                repair.add(turn, role, text, fault)
        yield None
    if repair is not None:
        yield now, repair


def table_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def report(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conv_id: counts of rows, gaps, faults and illegal neighbours, cost, audit (the edits' letters), and the
    SHA-256 of the repaired turns as `role:text`, newline-joined. present: rows where it is false only name a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def begin(conv: int | None) -> Repair:
            audit, digest, kept = [], hashlib.sha256(), [0]

            def turn(letter: str, role: str | None, text: str | None) -> None:
                audit.append(letter)
                if role is not None:
                    digest.update(f"{'\n' if kept[0] else ''}{role}:{text}".encode())
                    kept[0] += 1

            state["audit"], state["digest"] = audit, digest
            return Repair(turn)

        names = [x.split()[0] for x in REPORT.split(", ")]
        kinds, out = [*[pa.int64()] * 8, pa.string(), pa.string()], []
        for event in conversations(batches, begin):
            if event is not None:
                conv, r = event
                cost = r.survivors.finish()
                out.append((conv, r.rows, r.gaps(), *r.faults[1:], r.illegal, cost, "".join(state["audit"]), state["digest"].hexdigest()))
            elif out:
                yield table_of(out, names, kinds)
                out = []
        if out:
            yield table_of(out, names, kinds)

    return ordered(rows, present).mapInArrow(run, REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired turns in order; deleted rows have an edit but neither role nor text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names, kinds = [x.split()[0] for x in TURNS.split(", ")], [pa.int64(), pa.int64(), *[pa.string()] * 3]

        def begin(conv: int | None) -> Repair:
            place = [0]

            def turn(letter: str, role: str | None, text: str | None) -> None:
                out.append((conv, place[0], letter, role, text))
                place[0] += 1

            return Repair(turn)

        for event in conversations(batches, begin):
            if event is not None:
                event[1].survivors.finish()
            elif out:
                yield table_of(out, names, kinds)
                out.clear()
        if out:
            yield table_of(out, names, kinds)

    return ordered(rows).mapInArrow(run, TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32("conv_id:turn") % 20, nulls as one space: 0 drops the row (present is false),
    1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"), F.explode(times).alias("copy"))


ship(__name__)
