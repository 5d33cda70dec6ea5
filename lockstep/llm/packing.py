"""Operator 2, best-fit packing with certified bounds.

Documents become token pieces of at most ``capacity`` ids. Pieces that fill a sequence alone are done. The others are dealt to
partitions; each runs best-fit decreasing and compares its number of bins with a lower bound from dual-feasible functions.
A partition that meets its bound is certified and offers only its emptiest bin for exchange; one with a gap offers every bin
with room. What is offered is dealt anew to fewer, larger partitions and packed again, until the whole meets the bound of the
whole, one partition is left, or ``max_rounds`` is reached. Best fit needs no tree here: the bins with a given room are a
stack, and the stacks in use are bits of one integer, whose lowest set bit above the size is the tightest fit.

Defined results: null text is empty and gives one piece of one id; every row, repeated ones too, is packed by itself; null
doc_ids are kept; other columns are ignored; an empty table gives no rows. Pieces of one length are interchangeable.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.encoding import document_ids, slices
from lockstep.sources.shared import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, part int, bins long, bound long, offers long, offered boolean"


def token_pieces(documents: DataFrame, ranks_path: str, json_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of each row of ``doc_id, text``: whole documents, or for longer ones a shorter first piece, then full ones."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = array.array("I", document_ids(text or "", ranks_path, json_path))
                    ids.append(end_id)
                    raw, n = memoryview(ids).cast("B"), len(ids)
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of ``count[x]`` items of each size x can undercut: the best of three families of
    dual-feasible functions."""
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    # sizes over capacity - t count as whole bins, those under t as nothing
    filled, many = np.cumsum(count * x), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    large = many[-1] - many[capacity - t]
    best = max(best, int((large + -(-(filled[capacity - t] - filled[t - 1]) // capacity)).max(initial=0)))
    # rounding to multiples of 1 / k, exact multiples of 1 / (k + 1) kept
    for k in range(1, min(100, capacity) + 1):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        worth = np.where(exact, k * x, (scaled // capacity) * capacity)  # over k * capacity
        best = max(best, -(-int((count * worth).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fill = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            stacks[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def _pack_partitions(items: DataFrame, capacity: int, turn: int) -> DataFrame:
    names = [c.split()[0] for c in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        offered = fill < capacity
        if len(fill) == bound:
            offered &= np.arange(len(fill)) == fill.argmin()
        part = TaskContext.get().partitionId()
        same = np.ones(len(sizes), np.int64)
        columns = [pa.array((turn << 56) + (part << 32) + bins), pa.array(offsets), pa.array(same.astype(np.int32) * part), pa.array(same * len(fill)), pa.array(same * bound), pa.array(same * int(offered.sum())), pa.array(offered[bins])]
        placed = pa.Table.from_arrays([*table.columns, *columns], names=names)
        yield from placed.to_batches(max_chunksize=20_000)

    return items.mapInArrow(run, PLACED)


def pack(pieces: DataFrame, capacity: int = 1024, per_partition: int = 50_000, max_rounds: int = 4) -> tuple[DataFrame, dict]:
    """Places of all pieces (``PIECES`` plus sequence_id, offset), and the sequences used beside the bound of the whole.

    ``pieces`` must be a written table: it is read several times. A partition of round r takes ``per_partition * 4**r`` rows.
    """
    own = [c.split()[0] for c in PIECES.split(", ")]
    full = pieces.filter(F.col("length") == capacity)
    alone = full.select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    sizes = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        sizes[r["length"]] = r["count"]
    n_full, sizes[capacity] = int(sizes[capacity]), 0
    bound = lower_bound(sizes, capacity)
    done, used = [alone], 0
    items, n = pieces.filter(F.col("length") < capacity), int(sizes.sum())
    for turn in range(max_rounds):
        if not n:
            break
        parts = -(-n // (per_partition * 4**turn))
        placed = written(_pack_partitions(items.select(*own).repartition(parts), capacity, turn), "pack")
        stats = placed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("offers").alias("offers"), F.sum(F.col("offered").cast("long")).alias("rows"))
        bins, offers, rows = stats.agg(F.sum("bins"), F.sum("offers"), F.sum("rows")).first()
        if parts == 1 or turn + 1 == max_rounds or used + bins <= bound or not rows:
            used += bins
            done.append(placed.select(*own, "sequence_id", "offset"))
            break
        done.append(placed.filter(~F.col("offered")).select(*own, "sequence_id", "offset"))
        used += bins - offers
        items, n = placed.filter("offered"), rows
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out, {"sequences": n_full + used, "bound": n_full + bound}


def pack_documents(documents: DataFrame, ranks_path: str, json_path: str, capacity: int = 1024) -> DataFrame:
    pieces = written(token_pieces(documents, ranks_path, json_path, capacity=capacity), "pieces")
    return pack(pieces, capacity)[0]
