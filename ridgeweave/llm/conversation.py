"""Repair of the structure of conversations by the cheapest edits.

A conversation should be an optional system row and then pairs of user and
assistant, or nothing. Rows may be kept, given another role, deleted, or
inserted. A* searches the lattice of (rows read, last role written), ordered by
cost plus what every completion still has to pay: a deletion for each blank or
repeated row to come, and the charge for each truncated one. Ties go by the
audit, the string of edits so far. Two paths of one cost that meet never have
audits of which one begins the other, as the longer one would have paid for its
insertions, so the first path to reach a state is the one to keep.

Each conversation's rows stream through one task in order, sorted by Spark. A
block of rows is searched at a time, from all states that the block before left
open, with the hash of what each of them has written. So memory holds a block
and the audit, however long a conversation is; one very long conversation is
still one task's work, as its hash is one sequence. Whether a row repeats an
earlier one is found beforehand by an aggregation over digests, and travels as
a short row in front of the first of its kind.

Defined results: null roles and texts, and an empty role, are one space; null
turns come first; a null conv_id is a conversation of its own; rows of one turn
are in the order of their digests, so equal rows are neighbours and all but the
first are duplicates; texts of any length are read whole; a conversation
without rows has zeros, no edits and the hash of nothing; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: States of a row's faults, the first that holds.
SOUND, IS_BLANK, REPEATED, CUT = range(4)
#: Rows and characters after which a block is searched.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 23
#: Any state can do what another would at no more than this: insert a pair, delete a system row.
APART = 2 * INSERT + DELETE
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def following(state: int) -> int:
    """The state after a row that may be given either role."""
    return ASSISTANT if state == USER else USER


def after(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, or None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def mandatory(fault: int) -> int:
    """What a row costs at least: its deletion, or the charge for its truncation."""
    return DELETE if fault in (IS_BLANK, REPEATED) else min(DELETE, TRUNCATED) if fault == CUT else 0


def search(rows: list[tuple[str, int]], sources: dict[int, tuple[int, str]], goals: frozenset[int] | None = None) -> dict[int, tuple[int, str, int]]:
    """(cost, audit, source) of the states after ``rows`` of (initial, fault).

    ``sources`` are states before the rows with their cost and audit. With
    ``goals`` the search ends at the best state among them.
    """
    n = len(rows)
    to_go = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        to_go[i] = to_go[i + 1] + mandatory(rows[i][1])
    heap = [(cost + to_go[0], audit, 0, state, state) for state, (cost, audit) in sources.items()]
    heapq.heapify(heap)
    closed, out = set(), {}
    push = heapq.heappush
    while heap:
        f, audit, i, state, source = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - to_go[i]
        if i == n and (goals is None or state in goals):
            out[state] = (cost, audit, source)
            if goals is not None:
                break
        turned = following(state)
        push(heap, (f + INSERT, audit + "I", i, turned, source))
        if i == n:
            continue
        initial, fault = rows[i]
        rest = cost + to_go[i + 1]
        push(heap, (rest + DELETE, audit + "D", i + 1, state, source))
        if fault in (IS_BLANK, REPEATED):
            continue
        charge = TRUNCATED if fault == CUT else 0
        kept = after(state, initial)
        if kept is not None:
            push(heap, (rest + KEEP + charge, audit + "K", i + 1, kept, source))
        push(heap, (rest + REROLE + charge, audit + "R", i + 1, turned, source))
    return out


def replay(audit: str, rows: Iterable[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state after it) of every row that ``audit`` writes, from ``state`` on."""
    source = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        state = after(state, role[:1]) if edit == "K" else following(state)
        yield edit, role if edit == "K" else ROLE[state], text, state


@dataclass
class Open:
    """What one state has cost and written, up to a block's end."""

    cost: int
    audit: str
    hashed: object


def written(into, audit: str, rows: list[tuple[str, str]], state: int):
    """``into`` after the rows that ``audit`` writes, each on a line of its own."""
    for _, role, text, then in replay(audit, rows, state):
        into.update((f"{role}:{text}" if state == START else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        state = then
    return into


@dataclass
class Conversation:
    """Reads the rows of one conversation in order."""

    conv_id: int | None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    rows: list[tuple[str, str]] = field(default_factory=list)
    kinds: list[tuple[str, int]] = field(default_factory=list)
    chars: int = 0
    turns: int = 0
    first: int | None = None
    last: int | None = None
    before: str = ""
    settled: list[str] = field(default_factory=list)
    open: dict[int, Open] = field(default_factory=lambda: {START: Open(0, "", hashlib.sha256())})

    def add(self, turn: int | None, role: str, text: str, fresh: bool) -> None:
        core, initial, counts = text.rstrip(BLANK), role[0], self.counts
        fault = IS_BLANK if not core else REPEATED if not fresh else SOUND if core[-1] in ".!?" else CUT
        if fault:
            counts[("", "blank", "duplicate", "truncated")[fault]] += 1
        if self.before and self.before + initial not in ("su", "ua", "au"):
            counts["illegal"] += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        self.rows.append((role, text))
        self.kinds.append((initial, fault))
        self.chars += len(text)
        if len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self.advance()

    def advance(self) -> None:
        """Searches the block, drops states that can't be part of the best, and settles what all others share."""
        was = self.open
        found = search(self.kinds, {q: (o.cost, o.audit) for q, o in was.items()})
        most = min(cost for cost, _, _ in found.values()) + APART
        self.open = {}
        for q, (cost, audit, source) in found.items():
            if cost <= most:
                o = was[source]
                self.open[q] = Open(cost, audit, written(o.hashed.copy(), audit[len(o.audit) :], self.rows, source))
        shared = os.path.commonprefix([o.audit for o in self.open.values()])
        self.settled.append(shared)
        for o in self.open.values():
            o.audit = o.audit[len(shared) :]
        self.rows, self.kinds, self.chars = [], [], 0

    def result(self) -> tuple:
        ((cost, audit, source),) = search(self.kinds, {q: (o.cost, o.audit) for q, o in self.open.items()}, frozenset((START, ASSISTANT))).values()
        o = self.open[source]
        self.counts["cost"] = cost
        if self.turns:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        done = written(o.hashed, audit[len(o.audit) :], self.rows, source)
        return (self.conv_id, *(self.counts[c] for c in COUNTS), "".join(self.settled) + audit, done.hexdigest())


def repairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations whose sorted rows fill the batches."""
    now: Conversation | None = None
    fresh = None
    for batch in batches:
        out = []
        for conv_id, turn, digest, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.result())
                now, fresh = Conversation(conv_id), None
            if kind == 1:
                fresh = (turn, digest)
            elif kind == 2:
                now.add(turn, role, text, fresh == (turn, digest))
                fresh = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), REPORT_ARROW, strict=True)], schema=REPORT_ARROW)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.result(), REPORT_ARROW, strict=True)], schema=REPORT_ARROW)


def or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults that a hash of conversation and turn decides."""
    die = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), or_space("role").alias("role"), or_space("text").alias("text"), die.alias("die")).filter("die <> 0")
    text = F.when(F.col("die") == 1, F.lit("")).when(F.col("die") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("die") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("die") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def in_order(rows: DataFrame, every: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, kind, role, text) of each conversation in order, in one partition.

    Kind 0 names a conversation, 1 says that the row behind it is the first
    with its role and text, 2 is a row.
    """
    role = F.when(or_space("role") == "", F.lit(" ")).otherwise(or_space("role"))
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), or_space("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256))
    r = r.withColumn("digest", digest)
    firsts = r.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("at")).select("conv_id", F.col("at.turn").alias("turn"), "digest", F.lit(1).alias("kind"))
    names = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    both = r.withColumn("kind", F.lit(2)).unionByName(firsts, allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "digest", "kind")]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "digest", "kind", "role", "text")


def report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Faults, cost, edits and hash of the repaired rows of each conversation in ``rows``, and in ``every`` where that is given."""
    return in_order(rows, rows if every is None else every).mapInArrow(repairs, REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations.

    Each conversation's audit travels in front of its rows, so they are
    rewritten as they stream by.
    """
    audits = report(rows).select("conv_id", F.col("audit").alias("text"), F.lit(0).alias("kind"))
    lines = in_order(rows, rows.select("conv_id").limit(0)).filter("kind = 2").unionByName(audits, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), F.asc(F.col("kind") > 0), F.asc_nulls_first("turn"), F.asc("digest")]
    sorted_rows = lines.repartition("conv_id").sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        lines_in = stream()
        rows_of = ((role, text) for _, _, role, text in lines_in)
        held: list[tuple] = []
        for conv_id, _, _, audit in lines_in:
            for place, (edit, role, text, _) in enumerate(replay(audit, rows_of, START)):
                held.append((conv_id, place, edit, role, text))
                if len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)

    return sorted_rows.select("conv_id", "kind", "role", "text").mapInArrow(run, "conv_id long, place long, edit string, role string, text string")
