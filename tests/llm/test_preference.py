"""Preference pairs against a plain rendering."""

import time

from pyspark.sql import functions as F

from jobquarry.llm import preference as P


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda turns: "".join(f"<|start|>{r}\n{t}<|end|>\n" for r, t in turns)
    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:])


def test_pairs(spark):
    conversations = {
        1: ([("system", "s"), ("user", "hello"), ("assistant", "good")], [("system", "s"), ("user", "hello"), ("assistant", "bad"), ("user", "oh")]),
        2: ([("user", "a")], [("user", "b")]),
        3: ([("user", "a"), ("assistant", "é中")], [("user", "a"), ("assistant", "é中")]),
        4: ([("user", "a"), ("assistant", "x")], [("user", "a")]),
        5: ([("user", ""), ("assistant", "")], [("assistant", ""), ("assistant", "")]),
        6: ([("assistant", "only")], []),
        7: ([("user", "x" * 200_000), ("assistant", "y" * 100_000)], [("user", "x" * 200_000), ("assistant", "z")]),
    }
    frame = lambda k: spark.createDataFrame(
        [(c, i, r, t, "extra") for c, sides in conversations.items() for i, (r, t) in enumerate(sides[k])], "conv long, pos int, role string, text string, prompt string"
    )
    rows = {r.pair: r for r in P.preference_pairs(frame(0), frame(1)).collect()}
    assert set(rows) == set(conversations)
    for c, (chosen, rejected) in conversations.items():
        row = rows[c]
        assert (row.prefix_turns, row.prompt, row.chosen, row.rejected) == plain(chosen, rejected)
        n = row.prefix_turns
        for text, mask, turns in ((row.chosen, row.chosen_mask, chosen[n:]), (row.rejected, row.rejected_mask, rejected[n:])):
            assert [text[s.start : s.end] for s in mask] == [f"{t}<|end|>" for r, t in turns if r == "assistant"]
    assert P.preference_pairs(frame(0).limit(0), frame(1).limit(0)).count() == 0


def test_turns_of_odd_tables(spark):
    rows = [(2, 1, "user", "b"), (2, 0, None, None), (2, 1, "user", "b"), (2, None, "x", "last"), (None, 0, "user", "lost"), (3, 5, "user", "alone")]
    turns = P.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.conv, r.pos, r.role, r.text) for r in turns.collect())
    assert got == [(2, 0, "", ""), (2, 1, "user", "b"), (2, 2, "user", "b"), (2, 3, "x", "last"), (3, 0, "user", "alone")]
    swapped = sorted((r.conv, r.pos, r.text) for r in P.swapped_endings(turns).collect())
    assert swapped == [(2, 0, ""), (2, 1, "b"), (2, 2, "b"), (2, 3, "alone"), (3, 0, "last")]


def test_a_conversation_of_a_hundred_thousand_turns(spark):
    """Time in proportion to the turns: masks are running sums, not arrays that grow."""
    def run(n):
        roles = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.concat(F.lit("t"), "id").alias("text"))
        turns = P.turns_of(rows)
        start = time.perf_counter()
        row = P.preference_pairs(turns, turns.where("pos < 10")).select("prefix_turns", F.size("chosen_mask").alias("spans"), "chosen", "chosen_mask").first()
        return time.perf_counter() - start, row

    run(1_000)
    seconds, row = run(100_000)
    assert (row.prefix_turns, row.spans) == (10, 49_995) and seconds < 60
    last = row.chosen_mask[-1]
    assert row.chosen[last.start : last.end] == "t99999<|end|>"


def test_repeated_positions_of_equal_rows(spark):
    """Rows equal in all columns are turns one after another."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b")]
    turns = P.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = P.preference_pairs(turns, P.swapped_endings(turns)).first()
    assert row.prefix_turns == 3 and row.chosen.count("assistant") == 1 and row.rejected == ""
