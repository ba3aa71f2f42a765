"""Best-fit packing with certified bin counts.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Full pieces are sequences of their
own. The others are dealt at random to parts of about ``part_rows`` pieces, and every part is packed best-fit
decreasing. Dual feasible functions bound each part's bins from below. A part whose bins meet its bound is
certified; the pieces of the others, and of every part's loosely filled bins, are exchanged: they are
dealt anew by another hash and packed again, and this goes on while it saves bins. Each row tells its part's gap to the bound.

Defined results: a null text is empty and holds the end id alone; rows with equal doc_id are packed each on its
own; an empty table gives no rows; columns other than doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import encoder
from lakesurvey.llm.common import small_batches, starts_of, stored

CAPACITY = 4096
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
SAVING = 0.999  # share of the bins taking part that an exchange must get below, or it was in vain
PLACED = PIECES + ", sequence_id long, offset long, fill long, gap long"


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` behind each document."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1


def piece_rows(path: str, end_id: int, capacity: int):
    """For mapInArrow: doc_id and text to the pieces of each document, without their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, n = encoder(path, False, True).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            for first, ids, lengths in encode(batch.column(1)):
                ids, lengths = with_end(ids, lengths, end_id)
                ids = ids.astype("<u4", copy=False)
                counts = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(len(row)) - starts_of(counts)[row]
                start = piece * capacity
                length = np.minimum(lengths[row] - start, capacity)
                at = starts_of(lengths)[row] + start
                crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist())]
                uid = (np.int64(task) << 40) + n + np.arange(len(row))
                n += len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), docs.take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins of these pieces: the best of three families of dual feasible functions.

    A dual feasible function gives each length a weight so that what fits into one bin never weighs more than
    one; total weight is then a bound for any packing.
    """
    if not len(lengths):
        return 0
    size = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((size * x).sum()) // capacity)
    # Lengths over capacity - t count as whole bins, those under t as nothing.
    for t in range(1, capacity // 2 + 1):
        inner = slice(t, capacity - t + 1)
        best = max(best, int(size[capacity - t + 1 :].sum()) + -(-int((size[inner] * x[inner]).sum()) // capacity))
    # Rounding (k + 1) * x down, but where it is whole.
    for k in range(1, 101):
        scaled = (k + 1) * x
        weight = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((size * weight).sum()) // (k * capacity)))
    # Over half a bin: one less what else could stand beside it, in units of t.
    for t in range(1, capacity // 2 + 1, 16):
        unit = capacity // t
        weight = np.where(2 * x > capacity, unit - (capacity - x) // t, np.where(2 * x < capacity, x // t, unit // 2))
        weight = np.where(2 * x == capacity, unit // 2, weight)
        if unit:
            best = max(best, -(-int((size * weight).sum()) // unit))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, best-fit decreasing, and the fill of each bin.

    Open bins wait by their room; a bit mask of the rooms that occur finds the smallest one that suffices.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for k, need in zip(order.tolist(), lengths[order].tolist()):
        fit = mask >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            at = waiting[room].pop()
            if not waiting[room]:
                mask &= ~(1 << room)
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = at, fills[at]
        fills[at] += need
        if room := room - need:
            waiting[room].append(at)
            mask |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def pack_part(capacity: int, round_no: int):
    """For applyInPandas: one part's pieces to their places, with each bin's fill and the part's gap."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, fills = best_fit(lengths, capacity)
        rows["sequence_id"] = (np.int64(round_no) << 56) + (np.int64(key[0]) << 28) + bins
        rows["offset"], rows["fill"] = offsets, fills[bins]
        rows["gap"] = len(fills) - least_bins(lengths, capacity)
        return rows[["uid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "gap"]]

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, part_rows: int = 50_000, patience: int = 2, loose: float = 0.97) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a word vocabulary. Parts hold ``part_rows`` pieces on
    average, whatever the input. Bins filled less than ``loose``, or in a part that isn't certified and not full, take part in the exchanges, which go on
    until ``patience`` of them in a row saved less than one in a thousand of the bins that took part. ``gap`` tells how many bins the part that placed a row has beyond its bound: 0 is certified.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stored(docs.select("doc_id", "text").mapInArrow(piece_rows(tokenizer, end_id, capacity), PIECES), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")})
    out, left = [full.select(*PLACED_OUT)], pieces.where(F.col("length") < capacity)
    count, before, vain, k = left.count(), None, 0, -1
    while count:
        k += 1
        parts = -(-count // part_rows)
        dealt = left.select(*[c.split()[0] for c in PIECES.split(", ")], F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)).alias("part"))
        placed = stored(dealt.groupBy("part").applyInPandas(pack_part(capacity, k), PLACED), "packed")
        again = (F.col("fill") < loose * capacity) | ((F.col("gap") > 0) & (F.col("fill") < capacity))
        bins = F.count_distinct(F.when(again, F.col("sequence_id")))
        seen = placed.agg(F.sum(again.cast("long")).alias("n"), bins.alias("bins")).first()
        n, now = seen["n"] or 0, seen["bins"]
        vain = vain + 1 if before is not None and now > SAVING * before else 0
        # One part can't exchange with others. Numbers of sequences have room for 127 rounds.
        if parts == 1 or not n or vain == patience or k == 126:
            out.append(placed.select(*PLACED_OUT))
            break
        out.append(placed.where(~again).select(*PLACED_OUT))
        left, count, before = placed.where(again), n, now if before is None else min(before, now)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


PLACED_OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"]
