"""Structure repair of conversations: cheapest edits to a well-formed sequence of roles.

A conversation should be empty, or ``(system)? (user assistant)+``. Its rows are edited:
kept, given the role user or assistant, deleted, or preceded by an inserted empty turn; every
edit has a price, and among the cheapest edits those win whose initials are least in ASCII.

1. Rows are numbered in their order and judged by built-in functions; the numbered rows are
   a stored table. Repeats of a role and text are found by a window over their digest.
2. **Secondary-sorted stream.** What the edits depend on (a letter and two flags per row, no
   texts) is repartitioned by conversation and sorted by position, last row first. A
   task streams through many conversations and carries the four costs of the current
   one (from each state of the sequence to a proper end) from Arrow batch to Arrow batch.
   Per row it notes for each state how many turns to insert and which edit to take: four
   bytes. Notes beyond ``NOTES_IN_MEMORY`` go to an unlinked spill file of the task
   attempt, as Spark's own sorts spill; nothing else ever reads it.
3. With the first row done, the notes are followed from the start: the cheapest edits come
   out in order, in pieces of ``PIECE`` rows.
4. Pieces and rows, texts included, are streamed once more in order; the state is carried
   along, and the repaired turns are hashed (or rendered) without being gathered.

The prices depend on the rows that follow, and the least initials on the edits that follow,
so the costs are computed from the end; the texts pass by only after that.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.frames import stored

#: Fixed prices.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOT_POSSIBLE = 1 << 40
#: States: nothing yet, after system, after user, after assistant; the first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that may follow each state by insertion or a new role, and the state it leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row with this initial leads from each state; None: it may not stand there.
KEPT = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
EDITS = "DKR"
#: Bytes of notes that a task keeps in memory, and rows per piece of edits.
NOTES_IN_MEMORY, PIECE = 32 << 20, 50_000
#: Results that a task returns at once; a piece or an audit has a letter or so per row.
RESULTS = 200

WORDLESS, CLOSED = r"^[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"


def judged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of the numbered rows: ``conv, pos, role, text``, and their faults.

    ``turns`` has ``conv, turn, role, text``. Order: turn (nulls first), role, text. Null roles
    and texts are one space. The second table has ``conv, pos, turn, initial, fault, illegal``;
    ``fault`` is the first that holds of blank, duplicate, truncated.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = stored(
        turns.select("conv", "turn", space("role"), space("text"))
        .withColumn("pos", F.row_number().over(order).cast("long") - 1)
        .withColumn("initial", F.substring("role", 1, 1))
        .withColumn("blank", F.col("text").rlike(WORDLESS))
        .withColumn("truncated", ~F.col("text").rlike(CLOSED))
        .withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))),
        "turns",
    )
    again = F.row_number().over(Window.partitionBy("conv", "digest").orderBy("pos")) > 1
    before = F.lag("initial").over(Window.partitionBy("conv").orderBy("pos"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("truncated"), "truncated")
    light = stored(
        numbered.select("conv", "pos", "turn", "initial", "blank", "truncated", "digest")
        .withColumn("fault", fault)
        .withColumn("pair", F.concat(before, "initial"))
        .select("conv", "pos", "turn", "initial", "fault", (F.col("pair").isNotNull() & ~F.coalesce("pair", F.lit("")).isin("su", "ua", "au")).alias("illegal")),
        "judged",
    )
    return numbered.select("conv", "pos", "role", "text"), light


def counts(light: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal`` by partial aggregation."""
    number = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    span = (F.max("turn") - F.min("turn") + 1).cast("long")
    # One row per turn first, so that no task holds the distinct turns of a conversation.
    by_turn = light.groupBy("conv", "turn").agg(
        *(number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), number(F.col("illegal")).alias("illegal")
    )
    return by_turn.groupBy("conv").agg(
        F.coalesce(span - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated", "illegal")),
    )


class _Notes:
    """Four bytes per row, written last row first and read in blocks from the other end."""

    def __init__(self):
        self.rows, self.file, self.written = bytearray(), None, 0

    def add(self, note: bytes) -> None:
        self.rows += note
        if len(self.rows) >= NOTES_IN_MEMORY:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(self.written)
            self.file.write(self.rows)
            self.written += len(self.rows)
            self.rows = bytearray()

    def first_to_last(self) -> Iterator[bytes]:
        """Blocks of notes, the latest written first; each is to be read backwards."""
        yield bytes(self.rows)
        at = self.written
        while at:
            size = min(NOTES_IN_MEMORY - NOTES_IN_MEMORY % 4, at)
            at -= size
            self.file.seek(at)
            yield self.file.read(size)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _ends() -> list[int]:
    """Costs from each state when no row is left: insertions only."""
    return [0, 2 * INSERT, INSERT, 0]


def _row_costs(initial: str, fault: str | None, after: list[int]) -> tuple[list[int], bytes]:
    """Costs from each state before a row, given those behind it, and the note for them.

    A note has a byte per state: insertions before the row (0 to 2), edit, state after it.
    More than two insertions come back to a state and never pay.
    """
    late = TRUNCATED if fault == "truncated" else 0
    must_go = fault in ("blank", "duplicate")
    taken = []
    for state in range(4):
        options = [(DELETE + after[state], 0, state)]
        if not must_go:
            kept = KEPT.get(initial, (None,) * 4)[state]
            if kept is not None:
                options.append((KEEP + late + after[kept], 1, kept))
            options.append((REROLE + late + after[NEXT[state]], 2, NEXT[state]))
        # Of equal cost, the least initial: D before K before R.
        taken.append(min(options))
    costs, note = [], bytearray(4)
    for state in range(4):
        best = None
        at = state
        for inserts in range(3):
            cost, edit, to = taken[at]
            # As ASCII goes, D < I < K < R.
            order = "D" if inserts == 0 and edit == 0 else "I" * inserts + EDITS[edit]
            option = (cost + inserts * INSERT, order, inserts, edit, to)
            best = option if best is None else min(best, option)
            at = NEXT[at]
        costs.append(best[0])
        note[state] = best[2] << 4 | best[3] << 2 | best[4]
    return costs, bytes(note)


def _pieces(conv, notes: _Notes, cost: int) -> Iterator[dict]:
    """The edits along the cheapest way: pieces of rows, then the insertions at the end."""
    state, start, count, out = START, 0, 0, []
    for block in notes.first_to_last():
        for at in range(len(block) - 4, -1, -4):
            note = block[at + state]
            out.append("I" * (note >> 4) + EDITS[note >> 2 & 3])
            state, count = note & 3, count + 1
            if count - start == PIECE:
                yield {"conv": conv, "pos": start, "edits": "".join(out), "cost": cost}
                start, out = count, []
    out.append("I" * (0, 2, 1, 0)[state])
    yield {"conv": conv, "pos": start, "edits": "".join(out), "cost": cost}


def _cheapest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by conversation, last row first, to pieces of edits."""
    conv, after, notes, known, out = None, _ends(), None, {}, []

    def finished():
        for piece in _pieces(conv, notes, after[START]):
            out.append(piece)
            if len(out) == RESULTS:
                yield pd.DataFrame(out)
                out.clear()
        notes.close()

    for batch in batches:
        for this, initial, fault in zip(batch["conv"], batch["initial"], batch["fault"], strict=True):
            if notes is None or this != conv:
                if notes is not None:
                    yield from finished()
                conv, after, notes = this, _ends(), _Notes()
            # Costs differ from each other by a few units, so a few hundred cases are all there are.
            least = after[START]
            case = (initial if initial in KEPT else "", fault if isinstance(fault, str) else None, *(c - least for c in after))
            if case not in known:
                known[case] = _row_costs(case[0], case[1], [c - least for c in after])
            costs, note = known[case]
            after = [c + least for c in costs]
            notes.add(note)
    if notes is not None:
        yield from finished()
    if out:
        yield pd.DataFrame(out)


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, each piece of edits before its first row, to one result per conversation."""
    conv, state, edits, at, digest, begun, audit, cost, out = None, START, "", 0, None, False, [], 0, []

    def turn(role: str, text: str) -> None:
        nonlocal begun
        digest.update((("\n" if begun else "") + role + ":" + text).encode())
        begun = True

    def inserted() -> None:
        nonlocal state, at
        while at < len(edits) and edits[at] == "I":
            state = NEXT[state]
            turn(ROLE[state], "")
            at += 1

    def finished() -> Iterator[pd.DataFrame]:
        inserted()
        out.append({"conv": conv, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
        if len(out) == RESULTS:
            yield pd.DataFrame(out)
            out.clear()

    for batch in batches:
        for this, piece, price, role, text in zip(batch["conv"], batch["edits"], batch["cost"], batch["role"], batch["text"], strict=True):
            if digest is None or this != conv:
                if digest is not None:
                    yield from finished()
                conv, state, edits, at, digest, begun, audit = this, START, "", 0, hashlib.sha256(), False, []
            if isinstance(piece, str):
                inserted()
                edits, at, cost = piece, 0, int(price)
                audit.append(piece)
                continue
            inserted()
            edit = edits[at]
            at += 1
            if edit == "K":
                state = KEPT[role[0]][state]
                turn(role, text)
            elif edit == "R":
                state = NEXT[state]
                turn(ROLE[state], text)
    if digest is not None:
        yield from finished()
    if out:
        yield pd.DataFrame(out)


def repaired(rows: DataFrame, light: DataFrame) -> DataFrame:
    """``conv, cost, audit, repaired_sha256`` of each conversation with rows."""
    # As text, so that no id passes through a float on its way to pandas; null is no number.
    named = F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv")
    backwards = light.select(named, "pos", "initial", "fault").repartition("conv").sortWithinPartitions("conv", F.desc("pos"))
    pieces = stored(backwards.select("conv", "initial", "fault").mapInPandas(_cheapest, "conv string, pos long, edits string, cost long"), "edits")
    none = F.lit(None).cast("string")
    both = rows.select(named, "pos", F.lit(1).alias("kind"), none.alias("edits"), F.lit(None).cast("long").alias("cost"), "role", "text").unionByName(
        pieces.select("conv", "pos", F.lit(0).alias("kind"), "edits", "cost", none.alias("role"), none.alias("text"))
    )
    forwards = both.repartition("conv").sortWithinPartitions("conv", "pos", "kind").select("conv", "edits", "cost", "role", "text")
    done = forwards.mapInPandas(_apply, "conv string, cost long, audit string, repaired_sha256 string")
    return done.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv"), "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    One row per conversation of ``turns`` (``conv long, turn long, role, text``; other columns
    play no part). Rows with a null ``conv`` are one conversation; null turns come first and
    count for no gap; null roles and texts are one space; rows alike in all columns are turns
    of their own, of which the later are duplicates. A role counts by its first letter as it
    is written. An empty table gives an empty one.
    """
    rows, light = judged(turns)
    counted, fixed = counts(light), repaired(rows, light)
    joined = counted.join(fixed, counted["conv"].eqNullSafe(fixed["conv"]))
    return joined.select(counted["conv"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with some rows dropped, emptied, cut, repeated or given a wrong role.

    Which, is decided by ``crc32(conv_id:turn) % 20`` (nulls there are one space): 0 drops the
    row, 1 empties its text, 2 removes the marks ``. ! ?``, 3 repeats it, 4 makes it a user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    return rows.where("fate <> 0").select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("again")


def repair_of_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`repair` after :func:`damaged`, with a row for every id of ``conversations``.

    A conversation without rows after the damage has zeros, no edits and the hash of nothing.
    """
    found = repair(damaged(conversations)).withColumnRenamed("conv", "found")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["found"]), "left")
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.select(
        "conv_id", *(v.alias(c) for c, v in zero.items()),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
