"""Best-fit packing with certified bounds: partitions whose bin count is above their lower bound exchange documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import fast_encoder, vocabulary
from .common import Scratch, documents, rows_of, written

CAPACITY, END_ID = 2048, 0
#: Pieces that one group packs: bounds its memory, and is ample for best fit to come near its bound.
GROUP = 6_000
#: Times that documents are exchanged at most; each leaves a valid packing.
ROUNDS = 4


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of each document's ids and the id 0 after them.

    Only documents of more than `capacity` ids are cut; then the first piece takes the remainder.
    A null text counts as empty: one piece with the id 0. Null and repeated doc_ids are kept as
    they are; an empty table gives none; other columns are ignored.
    """
    spec, end = vocabulary(docs.sparkSession, vocabulary_path), np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = fast_encoder(spec.value)
        for ids, texts in rows_of(batches, 1 << 18):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(ids, texts):
                raw = c.encode(text) + end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc_id, k, a, b - a, raw[4 * a : 4 * b])):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of the dual feasible functions that round sizes over capacity-k up to all and drop those under k.

    counts: how many items have each size from 0 to capacity. No packing has fewer bins.
    """
    counts = np.asarray(counts, "i8")
    sizes = np.arange(capacity + 1)
    number, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * sizes)))
    n, s = (lambda a, b: number[b] - number[a]), (lambda a, b: total[b] - total[a])  # of sizes a <= x < b
    half, k = capacity // 2 + 1, np.arange(capacity // 2 + 1)
    wide = n(capacity + 1 - k, capacity + 1)
    middle, middle_sum = n(half, capacity + 1 - k), s(half, capacity + 1 - k)
    small = s(np.minimum(k, half), half)
    return int((wide + middle + np.maximum(0, -(-(small - (middle * capacity - middle_sum)) // capacity))).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin; a bit set of the free room that bins have finds the tightest bin."""
    bins, offsets, fills = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8"), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, "i8")


def _packer(turn: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, lengths = table["group"][0].as_py(), table["length"].to_numpy().astype("i8")
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        gap = len(fills) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # bins that open again: with a gap all that aren't nearly full, without one only the emptiest
        again = (fills < capacity - capacity // 128) if gap > 0 else (fills == fills.min()) & (fills < capacity)
        return pa.table({"row": table["row"], "length": table["length"], "sequence_id": (turn << 56) + (own << 24) + bins, "offset": offsets, "open": again[bins], "first": offsets == 0})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """items (length from 0 up to capacity, and any other columns) with sequence_id and offset; own columns of these two names are replaced.

    Groups of about `group` items, dealt out by a number of the written row, so that equal rows and such without ids part too,
    are packed best fit decreasing. Each group's bin count is certified against its dual-feasible-function bound. While all groups together
    are above the bound of the whole table, the documents of bins that are not full enough are exchanged
    (dealt into fewer groups) and packed again; what was packed before stays where that takes no fewer bins. Equal rows are separate
    items. An empty table gives an empty one. Only counts of sizes (capacity + 1 numbers) reach the driver. `group` bounds memory and
    `rounds` the work; either changes how near the bound the packing comes, not that it is one.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    with Scratch(items.sparkSession) as scratch:
        whole = items.select(F.struct(*(items[f"`{c}`"] for c in names)).alias("row"), items["length"].cast("long").alias("length"))
        left = scratch.written(whole.withColumn("number", F.monotonically_increasing_id()), "pieces")
        done: list[DataFrame] = []
        before: tuple[DataFrame, int] | None = None
        for turn in range(rounds + 1):
            sizes = {r["length"]: r["n"] for r in left.groupBy("length").agg(F.count("*").alias("n")).collect()}
            n = sum(sizes.values())
            if not n:
                break
            bound = lower_bound(np.array([sizes.get(x, 0) for x in range(capacity + 1)]), capacity)
            groups = -(-n // group)
            dealt = left.select("row", "length", F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(groups)).alias("group"))
            schema = StructType([left.schema["row"]]).add("length", "long").add("sequence_id", "long").add("offset", "long").add("open", "boolean").add("first", "boolean")
            packed = scratch.written(dealt.groupBy("group").applyInArrow(_packer(turn, capacity), schema), f"packed{turn}")
            used = packed.agg(F.sum(F.col("first").cast("long")).alias("bins"), F.sum((F.col("first") & F.col("open")).cast("long")).alias("open")).first()
            if before is not None and used["bins"] >= before[1]:
                done.append(before[0])  # no fewer: the documents stay where they were
                break
            if turn == rounds or used["bins"] <= bound or groups == 1 or not used["open"]:
                done.append(packed)
                break
            done.append(packed.where(~F.col("open")))
            before = packed.where("open"), used["open"]
            left = scratch.written(packed.where("open").select("row", "length", F.monotonically_increasing_id().alias("number")), f"open{turn}")
        kind = StructType([left.schema["row"]]).add("sequence_id", "long").add("offset", "long")
        out = items.sparkSession.createDataFrame([], kind)
        for part in done:
            out = out.unionByName(part.select("row", "sequence_id", "offset"))
        return written(out, "packed").select("row.*", "sequence_id", "offset")
