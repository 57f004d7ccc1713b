"""Repair of conversation structure by the cheapest edits.

A conversation is well formed if its roles read ``(system? (user assistant)+)?``. Rows
are kept, given another role or deleted, and empty turns are inserted, at a cost each;
of the cheapest edit lists the ASCII-least is taken. A backward pass over the rows
gives, for each state of the pattern, the cost of the rest. Those state-cost vectors
are stored at about every square root of the length only; the walk forward recomputes
one stretch of them at a time and emits the least edit that is still tight.

Spark shuffles a few bytes for each row first: they meet by conversation, where the
codes of its rows (one byte each) decide the edits. Then the texts meet their
conversation's edits, which come first in the order, and stream past them: no task
holds a conversation's texts. A conversation's edits and digest are one value each, so
one task goes through it; its memory is a few bytes for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colflow.llm.common import SPACE
from colflow.session import materialize

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: state after an inserted or re-roled turn, by the state before it
TURN = (USER, USER, ASSISTANT, USER)
#: state after a kept row, by its initial and the state before it
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: a row's code: place of its initial in INITIALS (3: another), 4 if it must go, 8 if it is cut off
OTHER, BAD, CUT = 3, 4, 8

Costs = tuple[int, int, int, int]


def _with_inserts(costs: list[float]) -> Costs:
    for _ in range(2):  # more than two inserts in a row lead back
        costs = [min(c, INSERT + costs[TURN[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: the costs of the end of a conversation: nothing, or a whole exchange, is before it
END = _with_inserts([0, float("inf"), float("inf"), 0])


def _options(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in ``state``: letter, cost, state after it; ASCII-ascending."""
    yield "D", DELETE, state
    if not code & BAD:
        extra = TRUNCATED if code & CUT else 0
        initial = code & 3
        after = KEPT[INITIALS[initial]].get(state) if initial != OTHER else None
        if after is not None:
            yield "K", extra, after
        yield "R", REROLE + extra, TURN[state]


@lru_cache(maxsize=4096)
def _step(code: int, after: Costs) -> tuple[int, Costs]:
    """Costs before a row from those after it (the least is 0), and how much the
    least rises."""
    costs = _with_inserts([min(cost + after[to] for _, cost, to in _options(code, s)) for s in range(4)])
    least = min(costs)
    return least, tuple(c - least for c in costs)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The least cost and the ASCII-least list of edits for the rows of a conversation
    by their codes: K(eep), R(erole), D(elete), I(nsert)."""
    n = len(codes)
    width = max(1, int(n**0.5))
    # costs before each row whose place is a multiple of ``width``, and at the end;
    # vectors hold the differences, the total counts what they rise by
    marks, costs, total = {n: END}, END, 0
    for i in range(n - 1, -1, -1):
        rise, costs = _step(codes[i], costs)
        total += rise
        if i % width == 0:
            marks[i] = costs
    total += costs[START]
    edits, state = [], START
    for first in range(0, n, width):
        stop = min(first + width, n)
        # the stretch again: costs before each of its rows
        stretch, costs, rises = [], marks[stop], []
        for i in range(stop - 1, first - 1, -1):
            stretch.append(costs)
            rise, costs = _step(codes[i], costs)
            rises.append(rise)
        before = costs
        for i in range(first, stop):
            after, rise = stretch.pop(), rises.pop()
            while True:
                tight = {e: to for e, cost, to in _options(codes[i], state) if cost + after[to] == before[state] + rise}
                if "D" in tight or INSERT + before[TURN[state]] != before[state]:
                    break
                edits.append("I")
                state = TURN[state]
            edit = min(tight)
            edits.append(edit)
            state = tight[edit]
            before = after
    while END[state]:
        edits.append("I")
        state = TURN[state]
    return total, "".join(edits)


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``gone`` after the damage that the
    checksum of ``conv_id:turn`` deals: a twentieth of the rows each is dropped
    (``gone``), emptied, freed of ``[.!?]``, repeated, and given to the user. A null
    role or text is one space, as is a null in the checksum's string."""
    told = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.pmod(F.crc32(told.cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    return rows.drop("col")


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one partition, by turn (nulls first), then role and
    MD5 of the text; equal rows are interchangeable."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "mark")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """The rows in their order, each with whether a conversation begins with it."""
    current = object()
    for batch in batches:
        columns = batch.to_pydict()
        for values in zip(*columns.values(), strict=True):
            row = dict(zip(columns, values, strict=True))
            yield row["conv_id"] != current, row
            current = row["conv_id"]


FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EDITS = "conv_id long, " + ", ".join(f"{f} long" for f in FAULTS) + ", audit string"
LEGAL = {"su", "ua", "au"}


class _Found:
    """What is known of the rows of one conversation so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.counts = dict.fromkeys(FAULTS, 0)
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, row: dict) -> None:
        turn, initial = row["turn"], row["initial"]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        fault = "blank" if row["blank"] else "duplicate" if row["nth"] > 1 else "truncated" if row["cut"] else None
        if fault:
            self.counts[fault] += 1
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in LEGAL
        self.before = initial
        code = INITIALS.find(initial) if initial else -1
        self.codes.append((code if code >= 0 else OTHER) | (BAD if fault in ("blank", "duplicate") else CUT if fault else 0))

    def row(self) -> tuple:
        self.counts["cost"], audit = cheapest_edits(bytes(self.codes))
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        return (self.conv_id, *self.counts.values(), audit)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((f, pa.int64()) for f in FAULTS), ("audit", pa.string())])
    found, done = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for begins, row in _by_conversation(batches):
        if begins:
            if found is not None:
                done.append(found.row())
            found = _Found(row["conv_id"])
            if len(done) >= 1000:
                yield out()
                done.clear()
        if not row["gone"]:
            found.add(row)
    if found is not None:
        done.append(found.row())
        yield out()


def find_edits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, gone)``: counts of
    its faults, ``cost`` and ``audit``, the cheapest edits in order, over the rows that
    are not ``gone``. Each row's first fault counts: blank, duplicate (role and text
    stand earlier), truncated. Rows are taken by turn, nulls first; rows of one turn by
    role, then MD5 of the text. A conversation all of whose rows are gone has zeros and
    no edits; rows without a conversation id are one conversation; an empty table
    stays empty."""
    bare = F.rtrim("text", F.lit(SPACE))
    slim = rows.select(
        "conv_id", "turn", "role", "gone",
        F.md5("text").alias("mark"),
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).repartition("conv_id")
    # on the partitioning by conversation: no other shuffle
    same = Window.partitionBy("conv_id", "gone", "role", "mark").orderBy("turn")
    marked = slim.withColumn("nth", F.row_number().over(same))
    return marked.sortWithinPartitions("conv_id", "turn", "role", "mark", "nth").mapInArrow(_edit_rows, EDITS)


class _Walk:
    """The edits of one conversation, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = TURN[self.state]
            self.at += 1
            yield "I", NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the turns up to this row's."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[0]][self.state]
        elif edit == "R":
            self.state = TURN[self.state]
            role = NAMES[self.state]
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str | None, str | None]]:
    """Conversation, edit, role and text of every edit; each conversation begins with
    a row without an edit."""
    walk, conv_id = None, None
    for begins, row in _by_conversation(batches):
        if begins:
            if walk is not None:
                for turn in walk.end():
                    yield conv_id, *turn
            conv_id, walk = row["conv_id"], _Walk(row["audit"])
            yield conv_id, "", None, None
        else:
            for turn in walk.row(row["role"], row["text"]):
                yield conv_id, *turn
    if walk is not None:
        for turn in walk.end():
            yield conv_id, *turn


def _meet(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits of each conversation, then its rows in their order."""
    texts = rows.filter(~F.col("gone")).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("mark"), "text", F.lit(None).cast("string").alias("audit")
    )
    null = F.lit(None).cast("string")
    heads = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), null.alias("role"), null.alias("mark"), null.alias("text"), "audit")
    return _ordered(texts.unionByName(heads), "kind").select("conv_id", "role", "text", "audit")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0, gapless), ``role`` and ``text`` of the repaired
    conversations, by the ``edits`` found for the ``rows``; those without turns left
    have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for conv_id, edit, role, text in _turns(batches):
            place = 0 if not edit else place
            if edit and edit != "D":
                out.append((conv_id, place, role, text))
                place += 1
            if len(out) >= 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return _meet(rows, edits).mapInArrow(run, "conv_id long, place long, role string, text string")


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id``, its ``audit`` and ``repaired_sha256``, the digest of the repaired
    ``role:text`` joined by newlines, hashed as the turns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, digest, empty = [], [], None, True

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": pa.array(digests, pa.string())})

        for conv_id, edit, role, text in _turns(batches):
            if not edit:
                if digest is not None:
                    digests.append(digest.hexdigest())
                if len(ids) >= 1000:
                    yield batch()
                    ids.clear()
                    digests.clear()
                ids.append(conv_id)
                digest, empty = hashlib.sha256(), True
            elif edit != "D":
                digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
        if digest is not None:
            digests.append(digest.hexdigest())
            yield batch()

    return _meet(rows, edits).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with ``repaired_sha256``."""
    digests = repaired_digests(rows, edits)
    same = edits["conv_id"].eqNullSafe(digests["conv_id"])
    return edits.join(digests, same).select(*(edits[c] for c in edits.columns), digests["repaired_sha256"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str, conversations: DataFrame | None = None) -> DataFrame:
    """All conversations after the dealt damage: their faults and cheapest repair."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet") if conversations is None else conversations
    rows = damage(conversations)
    edits = materialize(find_edits(rows), "edits")
    return repair(rows, edits).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
