"""Exact components of similar sets among the members of buckets.

A bucket is a key under which nodes are filed; any two nodes whose link matters share one.
Nobody needs all pairs of a bucket, only enough links to know which nodes hang together:

1. *Crowds*: large buckets (over ``SMALL`` members) whose least nodes meet in several of
   them have much the same members, so they are taken together, each member once. A crowd
   is parted by size, in steps that a link can span one of: a part has the members of its
   step and, as guests, those of the step below.
2. A few leaders, the least nodes of each crowd and the least one of each small bucket,
   meet all other members, once for all the buckets that the two share. Members of a
   tight group are connected after that.
3. Small buckets go on in rounds: members outside the root that most have by then become
   leaders in turn, eight times as many in each round, and meet the members whose root
   still differs.
4. In crowds, the members outside the main root (*outsiders*) are compared with all members
   of other roots inside tasks: outsiders by blocks, with an index from token to outsider,
   while the members stream by. A row is copied once per block of outsiders, so a tight
   crowd, which has none, costs nothing any more.

Every pair that shares a bucket is either compared or known to be connected: nothing is
missed. A task returns links that connect something new to it only, so that no output grows
with the pairs. What grows with the square are comparisons inside tasks between members of
a large bucket that stay apart from its main root.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.frames import arrow_map, chunks, connected_components, stored
from jobquarry.llm.hashing import shingle_sets

#: Leaders per small bucket grow by this factor from round to round.
GROWTH = 8
#: Members of a small bucket, and leaders of a crowd.
SMALL, LEADERS = 16, 3
#: Large buckets that two least nodes share if their crowds are one.
SHARED = 3
#: Members that meet a leader in one task; more are dealt over several copies of it.
MEETING = 512
#: Outsiders, and their shingles, that a task holds; members that pass by them.
BLOCK, BLOCK_SHINGLES, PASSING = 1024, 2_000_000, 4096
#: Up to so many rows of a few numbers (40 bytes) may be broadcast.
BROADCAST_ROWS = 500_000

Confirm = Callable[[DataFrame], DataFrame]


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether the sizes of two sets allow them to be similar."""
    return 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")


def _with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _main_roots(now: DataFrame, key: str) -> DataFrame:
    """``key, main``: the root that most members have, where there is more than one."""
    by_root = now.groupBy(key, "root").agg(F.count(F.lit(1)).alias("c"))
    most = by_root.groupBy(key).agg(F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    return stored(most.where("roots > 1").select(key, F.col("most.root").alias("main")), "open")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    links = stored(links.select("a", "b"), "links")
    if links.isEmpty():
        return roots
    # Earlier roots are stars already, so only what is new takes rounds.
    stars = links if roots is None else links.union(roots.select("node", "root"))
    return stored(connected_components(stars), "roots")


def _met(chosen: DataFrame, now: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a leader ``a`` and a member ``b`` of another root, each in one order."""
    a, b = chosen.alias("a"), now.alias("b")
    meet = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _fits("a", "b", percent))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    once = meet.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).groupBy(low.alias("low"), high.alias("high")).agg(F.min("a").alias("a"))
    return stored(once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), "pairs")


def components_of_buckets(members: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, words: int, confirm: Confirm) -> DataFrame:
    """``node, root`` of all nodes with a link; ``root`` is the least node of the component.

    ``members`` has ``key, node, n`` (n: size of the node's set), each row once. ``nodes``
    has ``node, id, fp``: the row of ``rows`` (``id, fp, text``) that stands for a node.
    ``confirm`` returns those of the pairs ``a, b`` that are links.
    """
    heads = stored(members.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")), "heads")
    small, large = heads.where(F.col("c") <= SMALL), heads.where(F.col("c") > SMALL)
    left = stored(members.join(small.select("key"), "key").select("key", "node", "n"), "small")
    crowds = _crowds(members, large, percent)
    both = _with_roots(left.unionByName(crowds.withColumnRenamed("crowd", "key").select("key", "node", "n")), None)
    first = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    fewest = F.when(F.col("large"), LEADERS).otherwise(1)
    sided = left.select("*", F.lit(False).alias("large")).unionByName(crowds.select(F.col("crowd").alias("key"), "node", "n", F.lit(True).alias("large")))
    leaders = sided.withColumn("rank", first).where(F.col("rank") <= fewest).select("key", "node", "n", F.col("node").alias("root"))
    leaders = stored(leaders, "leaders")
    roots = _merged(None, confirm(_met(leaders, both, percent)))

    left = left.join(leaders.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n")
    wanted = GROWTH
    while True:
        now = stored(_with_roots(left, roots), "members")
        open_ = _main_roots(now, "key")
        if open_.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
        chosen = now.join(open_, "key").where("root <> main").withColumn("rank", rank).where(F.col("rank") <= wanted)
        chosen = stored(chosen.select("key", "node", "n", "root"), "leaders")
        roots = _merged(roots, confirm(_met(chosen, now, percent)))
        left = now.join(open_.select("key"), "key", "left_semi").join(chosen.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n")
        wanted *= GROWTH

    roots = _merged(roots, _crowd_links(crowds, roots, nodes, rows, percent, words))
    return members.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def _crowds(members: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """``crowd, node, n``: the members of large buckets, once for each part of a crowd."""
    inside = stored(members.join(large.select("key", "head"), "key").select("head", "node", "n"), "inside")
    heads = inside.select(F.col("head").alias("node")).distinct()
    meet = inside.join(heads, "node").where("head <> node").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    crowd = connected_components(meet.where(F.col("c") >= SHARED)).select(F.col("node").alias("head"), F.col("root").alias("whole"))
    found = inside.distinct().join(crowd, "head", "left").select(F.coalesce("whole", "head").alias("whole"), "node", "n").distinct()
    # A little wider than the ratio of sizes that a link allows, so that rounding cannot lose one.
    step = F.col("n") if percent == 100 else F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * (1 + 1e-9)))
    guest = F.explode(F.array(F.lit(0), F.lit(1))).alias("guest")
    parts = found.select("whole", "node", "n", step.alias("step"), guest).select(
        F.xxhash64("whole", F.col("step") + F.col("guest")).alias("crowd"), "node", "n", F.col("guest") == 1
    ).toDF("crowd", "node", "n", "guest")
    parts = stored(parts, "parts")
    alive = parts.groupBy("crowd").agg(F.count(F.lit(1)).alias("c"), F.min("guest").alias("guests")).where("c > 1 AND NOT guests")
    return stored(parts.join(stored(alive.select("crowd"), "alive"), "crowd").select("crowd", "node", "n"), "crowds")


def _texts_of(roles: DataFrame, nodes: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``roles`` with the text of their ``node``."""
    named = stored(roles.join(nodes.select("node", F.col("id").alias("rep_id"), F.col("fp").alias("rep_fp")), "node"), "roles")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named.hint("merge")
    return rows.join(named, rows["id"].eqNullSafe(named["rep_id"]) & (rows["fp"] == named["rep_fp"])).select(*columns, "text")


def _copies(count: str) -> Column:
    return F.sequence(F.lit(0), F.col(count) - 1)


def _deal(node: str, over: str) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(7)), F.col(over)).cast("int")


def _crowd_links(crowds: DataFrame, roots: DataFrame | None, nodes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Links between outsiders of crowds and members of other roots."""
    now = stored(_with_roots(crowds, roots), "crowds")
    placed = now.join(_main_roots(now, "crowd"), "crowd").withColumn("outside", F.col("root") != F.col("main"))
    parts = F.greatest(F.lit(1), F.ceil(F.count_if("outside") / BLOCK), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / BLOCK_SHINGLES))
    sizes = stored(placed.groupBy("crowd").agg(parts.cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / PASSING).cast("int").alias("streams")), "sizes")
    placed = placed.join(sizes, "crowd")
    held = placed.where("outside").select("crowd", _deal("node", "blocks").alias("block"), F.explode(_copies("streams")).alias("stream"), F.lit(0).alias("kind"), "node", "root")
    passing = placed.select("crowd", F.explode(_copies("blocks")).alias("block"), _deal("node", "streams").alias("stream"), F.lit(1).alias("kind"), "node", "root")
    texts = _texts_of(held.union(passing), nodes, rows, ["crowd", "block", "stream", "kind", "node", "root"])
    task = ["crowd", "block", "stream"]
    return arrow_map(texts.repartition(*task).sortWithinPartitions(*task, "kind", "node"), _pass_by(percent, words), "a long, b long")


class _Block:
    """Outsiders of a crowd: an index from token to them, and what is known to hang together."""

    def __init__(self, nodes: list[int], roots: list[int], sets: list[np.ndarray]):
        self.nodes, self.roots = nodes, roots
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.at = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.at[1:], len(tokens))
        self.above: dict[int, int] = {}

    def find(self, root: int) -> int:
        path = []
        while (up := self.above.get(root, root)) != root:
            path.append(root)
            root = up
        for passed in path:
            self.above[passed] = root
        return root

    def links(self, node: int, root: int, own: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Links of a passing member that connect something new."""
        place = np.searchsorted(self.tokens, own)
        place[place == len(self.tokens)] = 0
        place = place[self.tokens[place] == own] if len(self.tokens) else place[:0]
        if not len(place):
            return
        starts, ends = self.at[place], self.ends[place]
        lengths = ends - starts
        flat = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.owner[flat], minlength=len(self.sizes))
        for i in np.flatnonzero(100 * shared >= percent * (self.sizes + len(own) - shared)).tolist():
            here, there = self.find(root), self.find(self.roots[i])
            if here != there:
                self.above[here] = there
                yield self.nodes[i], node


def _pass_by(percent: int, words: int):
    """Rows by crowd, block and stream: the outsiders first, then the members that pass by."""

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, held = None, None, ([], [], [])
        for chunk in chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"), words)
            names = [chunk.column(c).to_pylist() for c in ("crowd", "block", "stream", "kind", "node", "root")]
            found: list[tuple[int, int]] = []
            for i, (*this, kind, node, root) in enumerate(zip(*names, strict=True)):
                if this != task:
                    task, block, held = this, None, ([], [], [])
                own = values[at[i] : at[i + 1]]
                if kind == 0:
                    for part, value in zip(held, (node, root, own.copy()), strict=True):
                        part.append(value)
                    continue
                block = block or _Block(*held)
                found += block.links(node, root, own, percent)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pass_by


def _meetings(percent: int, words: int):
    """Streams rows sorted by leader: the leader's text, then those of whom it meets."""

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for chunk in chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"), words)
            a, salt, kind, node = (chunk.column(c).to_numpy() for c in ("a", "salt", "kind", "node"))
            found: list[int] = []
            for i in range(chunk.num_rows):
                mine = values[at[i] : at[i + 1]]
                if kind[i] == 0:
                    leader, own = (a[i], salt[i]), mine.copy()
                    continue
                if leader != (a[i], salt[i]):
                    raise ValueError(f"no text of class {a[i]}: documents changed while they were compared")
                place = np.searchsorted(own, mine)
                place[place == len(own)] = 0
                shared = int(np.count_nonzero(own[place] == mine)) if len(own) else 0
                if 100 * shared >= percent * (len(own) + len(mine) - shared):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(node[found])], ["a", "b"])

    return meetings


def similar_pairs(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets of shingles of ``words`` words are similar.

    A leader ``a`` with many members is copied, once per ``MEETING`` of them; a task holds
    a leader's set and about a megabyte of texts.
    """
    met = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("copies"))
    leads = met.select("a", F.explode(_copies("copies")).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("node"))
    follows = pairs.join(met, "a").select("a", _deal("b", "copies").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("node"))
    texts = _texts_of(leads.union(follows), nodes, rows, ["a", "salt", "kind", "node"])
    sorted_ = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "node")
    return arrow_map(sorted_, _meetings(percent, words), "a long, b long")
