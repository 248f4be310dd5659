"""Conversation repair against a plain recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from jobquarry.llm import repair

#: What may follow each state, as in the language (s?(ua)+)?.
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def order(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


def brute(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=order)
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for letter in "ua":
                if to := FOLLOWS.get((state, letter)):
                    cost, audit, out = best(i, to, inserted + 1)
                    options.append((cost + 2, "I" + audit, (FULL[letter] + ":", *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if to := FOLLOWS.get((state, role[:1])):
                    cost, audit, out = best(i + 1, to, 0)
                    options.append((cost + late, "K" + audit, (f"{role}:{text}", *out)))
                for letter in "ua":
                    if to := FOLLOWS.get((state, letter)):
                        cost, audit, out = best(i + 1, to, 0)
                        options.append((cost + 2 + late, "R" + audit, (f"{FULL[letter]}:{text}", *out)))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    letters = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, count=150, longest=14):
    rnd = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rnd.randint(0, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "User"])
            text = rnd.choice(["Well.", "So?", "And then", "", " \t", None, f"It is {turn}!", "Gut. ", "é"])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn + 3, None]), role, text))
    rnd.shuffle(rows)
    return rows


def got(spark, rows):
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    return {r.conv: tuple(r)[1:] for r in repair.repair(turns).collect()}


def by_conversation(rows):
    out = {}
    for conv, *turn in rows:
        out.setdefault(conv, []).append(tuple(turn))
    return {conv: brute(turns) for conv, turns in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_edits(spark, seed):
    rows = conversations(seed)
    assert got(spark, rows) == by_conversation(rows)


def test_batches_pieces_and_spills_change_nothing(spark, monkeypatch):
    """Tiny Arrow batches; notes that are spilled at once; pieces of three rows."""
    rows = conversations(3, count=12, longest=60)
    want = by_conversation(rows)
    monkeypatch.setattr(repair, "PIECE", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert got(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_spilled_notes_come_back_in_order(monkeypatch):
    monkeypatch.setattr(repair, "NOTES_IN_MEMORY", 24)
    for count in (0, 1, 5, 6, 7, 12, 40):
        notes = repair._Notes()
        for i in reversed(range(count)):
            notes.add(i.to_bytes(4, "big"))
        back = [int.from_bytes(b[at : at + 4], "big") for b in notes.first_to_last() for at in range(len(b) - 4, -1, -4)]
        assert back == list(range(count)) and (notes.file is not None) == (count >= 6)
        notes.close()


def test_a_giant_conversation(spark):
    """60,000 turns in one conversation, among small ones; twice a piece of edits."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(60_000) if i != 31_001]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    found = got(spark, rows)
    assert found[8][-2] == "KK"
    gaps, *_, illegal, cost, audit, digest = found[7]
    assert (gaps, illegal, cost) == (1, 1, 2)
    # Least of the equal ones: an inserted answer comes before a new role.
    assert audit == "K" * 31_001 + "I" + "K" * 28_998
    texts = [f"{'user' if i % 2 == 0 else 'assistant'}:" + ("" if i == 31_001 else f"turn {i}.") for i in range(60_000)]
    assert digest == hashlib.sha256("\n".join(texts).encode()).hexdigest()


def test_damage_nulls_and_ids_that_lose_all_rows(spark):
    rows = [(c, t, r, x, 5) for c, t, r, x in conversations(4, count=120, longest=4)] + [(2**62 + 1, 3, "user", "a", 5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    want = {}
    for conv, turn, role, text, _ in rows:
        own = want.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    want = {conv: brute(turns) for conv, turns in want.items()}
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair_of_damaged(frame).collect()} == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())
    assert repair.repair_of_damaged(frame.limit(0)).count() == 0
