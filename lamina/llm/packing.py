"""Best-fit packing planned on a histogram of lengths.

Only the counts of pieces by length reach the driver. Best-fit decreasing over
these counts gives ranges of ranks and the bins that they fill; documents then
take their slots by length and rank. A piece's rank is its place among those of
its length in its own partition, after those of the partitions before, so
ranking needs no shuffle and a common length is no task's alone. The plan and
the partitions' counts lie in the shared folder, where tasks look up their own.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, saved, scratch

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first bin, pieces a bin, first offset).

    Each piece goes where the least room that suffices is; the lowest bin
    among equals. The rows are as many as there are lengths times kinds of
    room at most, however many pieces there are.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of bins
    sizes: list[int] = []  # rooms in use, sorted
    out = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in rooms:
            rooms[room] = []
            insort(sizes, room)
        insort(rooms[room], (first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left > 0:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                each = capacity // length
                whole, rest = divmod(left, each)
                for n, q in ((whole, each), (1 if rest else 0, rest)):
                    if n:
                        out.append((length, rank, n * q, bins, q, 0))
                        put(capacity - q * length, bins, n)
                        bins, rank = bins + n, rank + n * q
                left = 0
                continue
            room = sizes[k]
            first, n = rooms[room].pop(0)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            rest = n - full
            if rest and left:
                out.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            if rest:
                insort(rooms[room], (first + full, rest))
            if not rooms[room]:
                del rooms[room]
                sizes.remove(room)
    return out


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and length of each piece of documents of n tokens: full bins first, then what is left."""
    count = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, piece, np.minimum(n[row] - piece * capacity, capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Slots of all documents in bins of capacity tokens: doc_id, piece, n_tokens, bin_id, bin_offset.

    A token is a run of non-space characters. A document longer than a bin is
    cut into full bins, which are its own, and a last piece, which is packed.
    Null and empty texts have no tokens and take no slot. Repeated rows and
    rows without a doc_id take slots like any other; which of the pieces of
    one length takes which of their slots is open. doc_ids are of any type,
    other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    path = scratch(spark, "packing")
    n = F.regexp_count(F.col("text"), F.lit(r"\S+")).cast("long")
    sized = checkpointed(docs.select("doc_id", n.alias("n")).where("n > 0"))

    def counted(batches):
        total = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            total += np.bincount(cut(batch.column(1).to_numpy(), capacity)[2], minlength=capacity + 1)
        some = np.flatnonzero(total)
        part = np.full(len(some), TaskContext.get().partitionId(), np.int32)
        yield pa.record_batch([pa.array(part), pa.array(some), pa.array(total[some])], ["part", "n_tokens", "n"])

    def before(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows).to_pandas()
            for part, own in table.groupby("part"):
                saved(f"{path}/{part}.npy", own[["n_tokens", "before"]].to_numpy(np.int64))
            yield pa.record_batch([pa.array([len(table)])], ["n"])

    parts = checkpointed(sized.mapInArrow(counted, "part int, n_tokens bigint, n bigint"))
    counts = {r.n_tokens: r.n for r in parts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    starts = parts.select("part", "n_tokens", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("n")).alias("before"))
    starts.repartition(partitions(spark), "part").mapInArrow(before, "n bigint").agg(F.sum("n")).collect()
    # full pieces are planned too: each has a bin to itself
    slots = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    saved(f"{path}/plan.npy", slots)

    def placed(batches):
        mine = f"{path}/{TaskContext.get().partitionId()}.npy"
        if not os.path.exists(mine):
            return
        slots = np.load(f"{path}/plan.npy", mmap_mode="r")
        length, first = np.ascontiguousarray(slots[:, 0]), np.ascontiguousarray(slots[:, 1])
        heads = np.searchsorted(length, np.arange(capacity + 2))
        rank = np.zeros(capacity + 1, np.int64)
        own = np.load(mine)
        rank[own[:, 0]] = own[:, 1]
        for batch in batches:
            row, piece, size = cut(batch.column(1).to_numpy(), capacity)
            by = np.argsort(size, kind="stable")
            sizes, at, n = np.unique(size[by], return_index=True, return_counts=True)
            bins, offsets = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            for s, a, k in zip(sizes, at, n):
                ranks = rank[s] + np.arange(k)
                rank[s] += k
                slot = slots[heads[s] + np.searchsorted(first[heads[s] : heads[s + 1]], ranks, "right") - 1]
                within = ranks - slot[:, 1]
                bins[by[a : a + k]] = slot[:, 3] + within // slot[:, 4]
                offsets[by[a : a + k]] = slot[:, 5] + within % slot[:, 4] * s
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(size), pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sized.mapInArrow(placed, f"doc_id {kind}, piece bigint, n_tokens bigint, bin_id bigint, bin_offset bigint")
