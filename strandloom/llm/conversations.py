"""Repair of conversation structure: the cheapest edits that make roles alternate, by Dijkstra's search.

A conversation is legal if the first letters of its roles match ``(s?(ua)+)?``. The search runs
on the lattice of nodes (turn index, grammar state), whose edges are made when a node is
popped: Keep (K) costs 0, Rerole to user or assistant (R) 3, Delete (D) 4, Insert of an empty
user or assistant turn (I) 3; a truncated row that is not deleted adds 3, and blank rows and
duplicates can only be deleted. The heap is ordered by (cost, audit), the audit being the
edits' letters so far; the first accepting node popped at the end gives the answer, so that
ties go to the audit that is least in ASCII. The grammar is deterministic and inserts cost
something, so an audit tells its path, and two equally cheap audits that meet in a node never
begin one with the other: what is popped first at a node stays first however it goes on.

Rows are dealt by conversation once and sorted on disk. A task streams them and keeps at most
``SEGMENT`` turns: longer conversations are searched a segment at a time, each search starting
from the labels that the one before left at its end, one for each grammar state, with the
state of a running SHA-256. So a conversation of any length takes the memory of a segment and
of its audits. A digest over all turns of a conversation can't be split by its definition,
which is why one conversation is one task's work; its duplicates are found by a sort that
spills to disk.

Rows are taken by turn, nulls first, then by role and text; so repeated rows are next to each
other. A null role or text counts as one space, and so does a null conv_id or turn in the key
of ``damaged``; rows with a null conv_id form one conversation. A role without letters adds no
initial, so that it can be kept anywhere. Texts of any length are read whole. An empty table
gives an empty result. Other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.common import SPACES, worker_cache

RECAST, REMOVE, INSERT, CLIPPED = 3, 4, 3, 3
SEGMENT = 1024

#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state and role that an inserted or recast turn brings, by the state before it.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
ACCEPTS = (START, ASSISTANT)
LEGAL_PAIRS = {"su", "ua", "au"}

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept turn, None where the grammar has no place for it."""
    if not initial:
        return state
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


Label = tuple[int, int, str, int]  # cost, rank of what came before, audit since then, state


def search(rows: list[tuple[str, int]], labels: list[Label], last: bool) -> list[Label]:
    """Labels at the end of ``rows`` (role, fault) from ``labels`` at their start, cheapest first.

    ``last``: the conversation ends here, and only the first accepting label is given. Otherwise
    there is one for each state that can be reached, and no insert stands at the end, as those
    are edges of the next segment.
    """
    n, heap, done = len(rows), [], set()
    for cost, rank, audit, state in labels:
        heappush(heap, (cost, rank, audit, 0, state))
    out: list[Label] = []
    while heap:
        cost, rank, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not last:
                out.append((cost, rank, audit, state))
                if len(out) == len(NEXT):
                    return out
                continue
            if state in ACCEPTS:
                return [(cost, rank, audit, state)]
        following = NEXT[state][0]
        if (i, following) not in done:
            heappush(heap, (cost + INSERT, rank, audit + "I", i, following))
        if i < n:
            role, fault = rows[i]
            if (i + 1, state) not in done:
                heappush(heap, (cost + REMOVE, rank, audit + "D", i + 1, state))
            if fault in (SOUND, TRUNCATED):
                more = CLIPPED if fault == TRUNCATED else 0
                kept = kept_state(state, role[:1])
                if kept is not None:
                    heappush(heap, (cost + more, rank, audit + "K", i + 1, kept))
                heappush(heap, (cost + more + RECAST, rank, audit + "R", i + 1, following))
    return out


class Replay:
    """The turns (edit, role, text) that an audit leaves of the rows it is given, one row after another."""

    def __init__(self, audit: str, state: int = START) -> None:
        self.audit, self.at, self.state = audit, 0, state

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        """What stands before the next row, or at the end."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state, role = NEXT[self.state]
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = kept_state(self.state, role[:1])
            yield edit, role, text
        elif edit == "R":
            self.state, role = NEXT[self.state]
            yield edit, role, text
        yield from self.inserts()

    def over(self, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        for row in rows:
            yield from self.row(*row)


class Running:
    """One conversation as its rows go by, at most a segment of them held."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.turns = 0
        self.least = self.most = self.before = None
        self.initial: str | None = None
        self.illegal = 0
        self.faults = [0, 0, 0, 0]
        # State, cost, audit, digest and number of turns of the cheapest edits up to the segment.
        self.labels: list[tuple[int, int, str, Any, int]] = [(START, 0, "", hashlib.sha256(), 0)]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (not self.turns or turn != self.before):
            self.turns += 1
            self.least, self.most, self.before = turn if self.least is None else self.least, turn, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        if len(self.rows) == SEGMENT:
            self.advance(False)
        self.rows.append((role, text, fault))

    def advance(self, last: bool) -> None:
        """Search the rows held and let go of them."""
        ranked = sorted(self.labels, key=lambda x: x[2])
        found = search([(r, f) for r, _, f in self.rows], [(cost, rank, "", state) for rank, (state, cost, *_) in enumerate(ranked)], last)
        texts, labels = [(r, t) for r, t, _ in self.rows], []
        for cost, rank, audit, state in found:
            begun, _, before, digest, n = ranked[rank]
            digest = digest.copy()
            for _, role, text in Replay(audit, begun).over(texts):
                digest.update(("\n" * (n > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                n += 1
            labels.append((state, cost, before + audit, digest, n))
        self.labels, self.rows = labels, []

    def result(self) -> tuple:
        self.advance(True)
        (_, cost, audit, digest, _), = self.labels
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # as longs wrap around, for turns at both ends of their range
        return gaps, *self.faults[BLANK:], self.illegal, cost, audit, digest.hexdigest()


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _summaries(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("conversations")
        conv, now = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * (1 + len(TYPES))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *TYPES], strict=True)], ["conv_id", *(c.split()[0] for c in COLUMNS.split(", "))])

        for batch in batches:
            for key, there, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != conv:
                    if now is not None:
                        out.append((conv, *now.result()))
                    conv, now = key, Running()
                if there:
                    now.add(turn, role, text, fault)
            if len(out) >= 1000 or sum(len(x[7]) for x in out) > 1 << 20:
                yield flush()
        if now is not None:
            out.append((conv, *now.result()))
        yield flush()

    return run


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, there, turn, role, text): rows broken on purpose, by crc32 of "conv_id:turn" modulo 20.

    0 drops the row (``there`` is false, so that its conversation stays known), 1 empties its
    text, 2 takes sentence ends out of it, 3 repeats it, 4 makes it a user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case").isin(0, 1), "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", (F.col("case") != 0).alias("there"), "turn", role.alias("role"), text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def given(df: DataFrame) -> DataFrame:
    """(conv_id, there, turn, role, text) of conversations as they are."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return df.select("conv_id", F.lit(True).alias("there"), F.col("turn").cast("long").alias("turn"), told("role"), told("text"))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with the first ``fault`` of each, dealt by conversation and sorted within it."""
    ends = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    rows = rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(ends == "", BLANK).when(seen, DUPLICATE).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    rows = rows.select("conv_id", "there", "turn", "role", "text", fault.alias("fault"))
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, there, turn, role, text): gaps, faults, cost, audit and digest.

    gaps: turns missing between the least and the largest; blank, duplicate, truncated: rows
    by their first fault; illegal: neighbours whose initials don't follow each other;
    repaired_sha256: of the repaired turns as "role:text", joined by newlines. A conversation
    without rows has zeros, no audit and the digest of nothing.
    """
    kind = rows.schema["conv_id"].dataType
    return in_order(rows).mapInArrow(_summaries(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {COLUMNS}")


def _turns(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = Replay(""), 0
        for batch in batches:
            out: list[tuple] = []
            for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:  # stands before the rows of its conversation
                    now, place = Replay(audit), 0
                for turn in now.inserts() if audit is not None else now.row(role, text):
                    out.append((conv, place, *turn))
                    place += 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), *[pa.string()] * 3], strict=True)], ["conv_id", "place", "edit", "role", "text"])

    return run


def repaired_turns(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, from 0.

    Audits stand before the rows of their conversations and are replayed along them, so that a
    task holds an audit and a batch of rows.
    """
    found = repairs(rows) if found is None else found
    kind = rows.schema["conv_id"].dataType
    audits = found.select("conv_id", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))))
    turns = rows.filter("there").select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    both = audits.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_turns(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")
