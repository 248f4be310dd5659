"""Preference formatting: one prompt and two masked completions per pair of conversations.

The prompt is the longest common prefix of turns (same role, same text) of the chosen and
the rejected conversation, rendered once. Each completion is the rest of its conversation,
with the character spans of the assistant's words, which are what a model learns from;
everything else is masked. If the whole of a conversation is common, its completion is empty.

Turns are compared by a join on pair and position, so the prefix is the least position at
which the two differ: two sums per pair, no conversation is gathered to compare it. Where
each turn begins in its text is a running sum over the turns. Only the rendering brings a
conversation's turns together, since they become one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.frames import stored

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "<|start|>", "\n", "<|end|>\n"
LEARNED = "assistant"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, pos, role, text``: turns numbered from 0 by turn, then role and text.

    Null roles and texts are empty; rows equal in all columns are two turns; rows without a
    conversation id belong to no conversation and are left out.
    """
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return (
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("pos", F.row_number().over(order) - 1)
        .select("conv", "pos", "role", "text")
    )


def _rendered() -> Column:
    return F.concat(F.lit(OPEN), F.col("role"), F.lit(MIDDLE), F.col("text"), F.lit(CLOSE))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    Both inputs have ``conv, pos, role, text`` with positions from 0 on without holes, and
    equal ``conv`` makes a pair; a conversation without a partner is paired with an empty
    one. Masks are arrays of ``start, end``: half-open character spans of what counts. All
    texts are kept whole. Other columns play no part.
    """
    sides = stored(
        chosen.select("conv", "pos", "role", "text", F.lit(True).alias("is_chosen")).union(
            rejected.select("conv", "pos", "role", "text", F.lit(False).alias("is_chosen"))
        ),
        "sides",
    )
    # Equal turns of both sides have one fingerprint; a position is common if it has two rows and one fingerprint.
    at_position = sides.groupBy("conv", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("role", "text")).alias("low"), F.max(F.xxhash64("role", "text")).alias("high"),
        F.min(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).alias("first"), F.max(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).alias("last"),
    )
    differs = (F.col("n") < 2) | (F.col("low") != F.col("high")) | (F.col("first") != F.col("last"))
    prefix = at_position.groupBy("conv").agg(
        F.coalesce(F.min(F.when(differs, F.col("pos"))), F.max("pos") + 1).cast("int").alias("prefix_turns")
    )
    prefix = stored(prefix, "prefixes")
    common = F.col("pos") < F.col("prefix_turns")
    part = F.when(common, "prompt").when(F.col("is_chosen"), "chosen").otherwise("rejected")
    marked = sides.join(prefix, "conv").where(F.col("is_chosen") | ~common).select("conv", "prefix_turns", "pos", "role", part.alias("part"), _rendered().alias("piece"), F.length("text").alias("length"))
    # Dealt once; the running sum and the gathering both find their rows together.
    earlier = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0))
    begin = before + F.length("piece") - F.col("length") - len(CLOSE)
    placed = marked.repartition("conv").select("*", begin.cast("int").alias("start"), (begin + F.col("length") + len(CLOSE) - 1).cast("int").alias("end"))
    learned = lambda name: (F.col("part") == name) & (F.col("role") == LEARNED)
    pieces = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("pos", "piece"))))
    spans = lambda name: F.array_sort(F.collect_list(F.when(learned(name), F.struct("pos", "start", "end"))))
    gathered = placed.groupBy("conv", "prefix_turns").agg(
        *(pieces(name).alias(name) for name in ("prompt", "chosen", "rejected")), *(spans(name).alias(f"{name}_mask") for name in ("chosen", "rejected"))
    )
    text = lambda c: F.concat_ws("", F.transform(c, lambda t: t["piece"])).alias(c)
    mask = lambda c: F.transform(c, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias(c)
    return gathered.select(
        F.col("conv").alias("pair"), "prefix_turns", text("prompt"), text("chosen"), text("rejected"), mask("chosen_mask"), mask("rejected_mask")
    )


def swapped_endings(turns: DataFrame) -> DataFrame:
    """Rejected partners for conversations that have none: the last turn of the neighbour.

    Conversation 2k and 2k + 1 exchange their last turns; one without a neighbour loses its
    last turn. A simple negative: a fluent ending to the wrong conversation.
    """
    last = turns.groupBy("conv").agg(F.max("pos").alias("last"))
    last = stored(last, "lasts")
    marked = turns.join(last, "conv")
    partner = F.when(F.pmod("conv", F.lit(2)) == 0, F.col("conv") + 1).otherwise(F.col("conv") - 1)
    endings = marked.where("pos = last").select(partner.alias("conv"), "role", "text")
    return marked.where("pos < last").select("conv", "pos", "role", "text").union(
        endings.join(last, "conv").select("conv", F.col("last").alias("pos"), "role", "text")
    )
