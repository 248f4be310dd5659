"""Removal of repeated passages: exact, on bytes, over all documents at once.

A byte goes if some 200-byte string covers it that also starts anywhere else. Sorting
every suffix of a large corpus would move each byte hundreds of times, so:

1. Every 200-byte string is assigned to an anchor inside it, the leftmost of the smallest
   hashes of its 32-byte grams. Equal strings have equal anchors at equal offsets, and an
   anchor serves a run of neighbouring strings, about 85 on average. Anchors whose gram
   occurs once are done with: none of their strings repeats.
2. Anchors whose whole surroundings repeat are done with as well: all their strings do.
3. The others' surroundings, one copy of each, meet by gram. Their texts to the right of
   the anchor, and those to the left read backwards, are put into suffix order by
   deep-shallow sorting. A string reaching ``o`` bytes to the left repeats if and only if
   its row shares its class at depth ``o`` on the left and at ``200 - o`` on the right
   with another row; classes are cuts of the common-prefix arrays.
4. A gram with very many different surroundings is not gathered: its strings are counted
   by fingerprint with partial aggregation instead, for every offset.

Null texts are empty; texts below 200 bytes lose nothing. Rows equal in id and text count
as separate documents, so both lose what they share. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.deep_shallow import suffix_order
from jobquarry.llm.frames import arrow_map, chunks, keyed, same_row, stored, unpacked, whole_groups
from jobquarry.llm.hashing import BASE, BYTE, INVERSE, joined_bytes, mixed, powers

LENGTH, GRAM = 200, 32
#: Grams with more different surroundings than this are counted by fingerprint instead.
GATHERED = 4096
#: Starts handled at once within a text; longer texts are cut into overlapping pieces.
PIECE = 1 << 20

ANCHORS = "id long, fp long, p int, lo int, hi int, gram long, around long"


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, gram, surroundings) of runs of starts, over joined texts."""
    width = length - GRAM + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    grams = BYTE[data]
    for k in range(5):
        step = 1 << k
        grams = mixed(grams[:-step] * BASE + grams[step:])
    lowest = _slide(grams, width, np.minimum)
    starts = len(data) - length + 1
    valid = np.ones(starts, bool)
    for end in offsets[1:].tolist():
        valid[max(0, end - length + 1) : end] = False
    lowest = np.where(valid, lowest, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    anchors = np.flatnonzero(grams == _slide(np.concatenate([pad, lowest, pad]), width, np.maximum))
    found = grams[anchors]

    new = valid.copy()
    new[1:] &= (lowest[1:] != lowest[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    after = valid.copy()
    after[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(after)
    value, begin = lowest[first], first.copy()
    runs: list[tuple[np.ndarray, ...]] = []
    active = np.arange(len(first))
    while len(active):
        j = np.searchsorted(anchors, begin[active])
        while (wrong := found[j] != value[active]).any():
            j[wrong] += 1
        at = anchors[j]
        runs.append((begin[active], np.minimum(last[active], at), at, value[active]))
        begin[active] = at + 1
        active = active[at < last[active]]
    lo, hi, at, gram = (np.concatenate(x) for x in zip(*runs, strict=True))

    values = grams * powers(BASE, len(grams))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    around = (sums[hi + length - GRAM + 1] - sums[lo]) * powers(INVERSE, len(data))[lo]
    around = mixed(around + (at - lo).astype(np.uint64) * BASE + (hi - lo).astype(np.uint64) * INVERSE)
    return lo, hi, at, gram, around


def _find_anchors(length: int, piece_size: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            known = np.asarray(chunk.column("id").is_valid())
            ids = chunk.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            fps = chunk.column("fp").to_numpy(zero_copy_only=False)
            data, offsets = joined_bytes(chunk.column("text"))
            for base in range(0, max(1, len(data) - length + 1), piece_size):
                piece = data[base : base + piece_size + length - 1]
                inside = np.clip(offsets - base, 0, None)
                inside = inside[inside <= len(piece)]
                lo, hi, at, gram, around = _anchors(piece, np.append(0, inside[inside > 0]), length)
                owner = np.searchsorted(offsets, lo + base, "right") - 1
                shift = base - offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner], mask=~known[owner]),
                        pa.array(fps[owner]),
                        *(pa.array((x + shift).astype(np.int32)) for x in (at, lo, hi)),
                        *(pa.array(x.view(np.int64)) for x in (gram, around)),
                    ],
                    ["id", "fp", "p", "lo", "hi", "gram", "around"],
                )

    return find


def _cut_surroundings(length: int):
    """For each wanted anchor of a text, the bytes left and right of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            rows: list[tuple] = []
            for text, wanted in zip(chunk.column("text"), chunk.column("wanted"), strict=True):
                data = text.as_buffer()
                data = data.to_pybytes() if data is not None else b""
                for w in wanted.as_py():
                    p, lo, hi = w["p"], w["lo"], w["hi"]
                    rows.append((w["gram"], w["around"], p - hi, p - lo, data[lo:p], data[p : hi + length]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["gram", "around", "o_min", "o_max", "left", "right"],
            )

    return cut


def _repeating_offsets(length: int):
    """Runs of offsets at which a row's string equals another row's, from rows sorted by gram."""

    def repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gram"]):
            grams = table.column("gram").to_numpy()
            count = len(grams)
            group = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]]))
            o_min, o_max = (table.column(c).to_numpy().astype(np.int64) for c in ("o_min", "o_max"))
            sides = []
            for column, known in (("left", 0), ("right", GRAM)):
                texts = table.column(column).to_pylist()
                if column == "left":
                    texts = [t[::-1] for t in texts]
                sides.append(suffix_order(texts, group, known))
            hit = np.zeros((length - GRAM + 1, count), bool)
            for o in range(length - GRAM + 1):
                own = (o_min <= o) & (o <= o_max)
                if np.count_nonzero(own) < 2:
                    continue
                classes = []
                for (order, shared), depth in zip(sides, (o, length - o), strict=True):
                    part = np.empty(count, np.int64)
                    part[order] = np.cumsum(shared < depth)
                    classes.append(part)
                rows = np.flatnonzero(own)
                pair = classes[0][rows] * (count + 1) + classes[1][rows]
                by = np.argsort(pair)
                twin = np.zeros(len(rows), bool)
                equal = pair[by][1:] == pair[by][:-1]
                twin[by[1:][equal]] = True
                twin[by[:-1][equal]] = True
                hit[o, rows[twin]] = True
            edge = np.diff(np.pad(hit.T, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[row]),
                    pa.array(table.column("around").to_numpy()[row]),
                    pa.array(begin.astype(np.int32)),
                    pa.array((end - 1).astype(np.int32)),
                ],
                ["gram", "around", "o_from", "o_to"],
            )

    return repeating


def _strings(length: int):
    """A fingerprint for every string of a row, for grams too frequent to be gathered."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, p = row["left"] + row["right"], len(row["left"])
                offsets = list(range(row["o_min"], row["o_max"] + 1))
                prints = [
                    int.from_bytes(hashlib.blake2b(text[p - o : p - o + length], digest_size=8).digest(), "big", signed=True)
                    for o in offsets
                ]
                n = len(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["gram"]] * n, pa.int64()),
                        pa.array([row["around"]] * n, pa.int64()),
                        pa.array(offsets, pa.int32()),
                        pa.array(prints, pa.int64()),
                    ],
                    ["gram", "around", "o", "print"],
                )

    return strings


def repeated_spans(docs: DataFrame, length: int = LENGTH, gathered: int = GATHERED, piece: int = PIECE) -> DataFrame:
    """``id, fp, spans`` for texts with repeated strings; spans (array of start, end) may overlap.

    ``docs`` has the columns of :func:`keyed`. The frame is planned over stored tables.
    """
    texts = docs.select("id", "fp", "text")
    anchors = arrow_map(texts.where(F.octet_length("text") >= length), _find_anchors(length, piece), ANCHORS)
    often = stored(anchors.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    members = stored(anchors.join(often, "gram"), "anchors")
    around = stored(
        members.groupBy("gram", "around").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "fp", "p", "lo", "hi")).alias("at")
        ),
        "surroundings",
    )
    kinds = stored(around.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    wanted = (
        around.join(kinds, "gram")
        .select("at.*", "gram", "around")
        .groupBy("id", "fp")
        .agg(F.collect_list(F.struct("gram", "around", "p", "lo", "hi")).alias("wanted"))
    )
    cut = arrow_map(
        texts.join(wanted, same_row(texts, wanted)).select("text", "wanted"),
        _cut_surroundings(length),
        "gram long, around long, o_min int, o_max int, left binary, right binary",
    )
    cut = stored(cut, "contexts")
    crowd = kinds.where(F.col("kinds") > gathered).select("gram")
    apart = cut.join(crowd, "gram", "left_anti")
    found = arrow_map(
        apart.repartition("gram").sortWithinPartitions("gram"),
        _repeating_offsets(length),
        "gram long, around long, o_from int, o_to int",
    )
    prints = arrow_map(
        cut.join(crowd, "gram", "left_semi"), _strings(length), "gram long, around long, o int, print long"
    )
    twins = prints.groupBy("gram", "o", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    crowded = prints.join(stored(twins, "twins"), ["gram", "o", "print"]).select(
        "gram", "around", F.col("o").alias("o_from"), F.col("o").alias("o_to")
    )
    whole = around.where("n > 1").select("gram", "around", F.lit(0).alias("o_from"), F.lit(length).alias("o_to"))
    repeats = stored(found.union(crowded).union(whole), "repeats")
    spans = members.join(repeats, ["gram", "around"]).select(
        "id",
        "fp",
        F.greatest(F.col("lo"), F.col("p") - F.col("o_to")).alias("start"),
        (F.least(F.col("hi"), F.col("p") - F.col("o_from")) + F.lit(length)).alias("end"),
    )
    return spans.groupBy("id", "fp").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _merged(spans: list[dict]) -> list[list[int]]:
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs


def _cleaned(least_bytes: int, least_words: int):
    return partial(_cut, least_bytes=least_bytes, least_words=least_words)


def _cut(batches: Iterator[pa.RecordBatch], least_bytes: int, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 8_000_000):
        out: list[tuple] = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = text.as_buffer()
            data = data.to_pybytes() if data is not None else b""
            # bytes.split() cuts at ASCII white space, as words are defined.
            runs = [(a, b) for a, b in _merged(spans.as_py() or []) if b - a >= least_bytes or len(data[a:b].split()) >= least_words]
            kept, at = [], 0
            for start, end in runs:
                kept.append(data[at:start])
                at = end
            kept = b"".join([*kept, data[at:]])
            removed = sum(end - start for start, end in runs)
            out.append((kept.decode("utf-8", "ignore"), len(data), removed, len(runs), hashlib.sha256(kept).hexdigest(),
                        [{"start": s, "end": e} for s, e in runs]))
        made = list(zip(*out, strict=True))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        names = ["kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], ["row", *names]
        )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", least_bytes: int = 0, least_words: int = 0
) -> DataFrame:
    """All rows and columns of ``docs``, with ``kept_text``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``removed`` (the maximal removed runs).

    Of the runs of repeated strings of ``length`` bytes, those stay that have fewer than
    ``least_bytes`` bytes and fewer than ``least_words`` words; by default none does.
    ``kept_text`` drops the halves of characters that a cut went through; the digest is
    over the exact remaining bytes. An empty table gives an empty one.
    """
    rows = keyed(docs, text, doc_id)
    spans = repeated_spans(rows, length)
    joined = rows.join(spans, same_row(rows, spans), "left").select("row", rows["text"], "spans")
    kind = rows.schema["row"].dataType.simpleString()
    cleaned = arrow_map(
        joined,
        _cleaned(least_bytes, least_words),
        f"row {kind}, kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "removed array<struct<start:int,end:int>>",
    )
    names = ["kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    return unpacked(cleaned, **{n: F.col(n) for n in names})
