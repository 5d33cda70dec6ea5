"""Operator 6, sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are sorted by size and each enters the open bin with the tightest room that still holds it; a B-tree of
the rooms finds it. That is done on levels. In tasks, the groups of a partition fill bundles of a small capacity, a fixed fraction of
all bytes. Of a task's bundles at most one is less than half full, so there are at most two for each such fraction and one more for each task;
while there are over ``MOST_TASKS`` tasks, bundles are bundled again in fewer. So the driver gets at most about 65,000 bundles
(``shards * BUNDLES_PER_SHARD`` fractions, three for each, and ``MOST_TASKS``), whatever the corpus. There the bundles fill the shards
in the same manner at the capacity of an even split; a bundle that fits nowhere goes to the emptiest shard, and a group
larger than an even share has a shard to itself. Each bundle gets a range of slots.

Rows get their slot inside their group by counting within 64 salts of doc_id first, so a group with a third of all rows is
spread over tasks. Defined results: null and empty texts are one group of size 16 a row; repeated rows are rows; null doc_ids come
first in their group; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.sources.shared import written

SALTS, BUNDLES_PER_SHARD, GROUPS_PER_TASK, MOST_TASKS = 64, 500, 20_000, 4096


class Rooms:
    """A B-tree of height two over (room, bin): leaves of at most ``2 * half`` entries, and their largest entries as the root."""

    def __init__(self, half: int = 256):
        self.half, self.leaves, self.tops = half, [[]], [(0, 0)]

    def add(self, room: int, name: int) -> None:
        at = min(bisect_left(self.tops, (room, name)), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, (room, name))
        if len(leaf) > 2 * self.half:
            self.leaves[at : at + 1] = [leaf[: self.half], leaf[self.half :]]
            self.tops[at : at + 1] = [leaf[self.half - 1], leaf[-1]]
        else:
            self.tops[at] = leaf[-1]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the entry with the least room of at least ``size``."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves) or not self.leaves[at]:
            return None
        leaf = self.leaves[at]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        elif len(self.leaves) > 1:
            del self.leaves[at], self.tops[at]
        else:
            self.tops[at] = (0, 0)
        return found


def best_fit_decreasing(sizes: Iterable[int], capacity: int, most_bins: int | None = None) -> list[int]:
    """The bin of each size; larger ones than the capacity have a bin alone. With ``most_bins``, what fits nowhere once all are
    open goes to the emptiest bin."""
    sizes = list(sizes)
    rooms, bins, room_of = Rooms(), [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.tightest(sizes[i])
        if found is not None:
            b = found[1]
        elif most_bins is None or len(room_of) < most_bins:
            b = len(room_of)
            room_of.append(capacity)
        else:
            b = max(range(len(room_of)), key=lambda k: (room_of[k], -k))
            if room_of[b] > 0:
                rooms.tightest(room_of[b])
        bins[i] = b
        room_of[b] -= sizes[i]
        if room_of[b] > 0:
            rooms.add(room_of[b], b)
    return bins


def place_bundles(sizes: list[int], shards: int) -> list[int]:
    """The shard of each bundle, sizes near equal."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rest, total, out, used = list(order), sum(sizes), [0] * len(sizes), 0
    while rest and used < shards - 1 and sizes[rest[0]] * (shards - used) >= total:
        out[rest[0]] = used
        total -= sizes[rest.pop(0)]
        used += 1
    for i, b in zip(rest, best_fit_decreasing([sizes[i] for i in rest], max(1, -(-total // (shards - used))), shards - used)):
        out[i] = used + b
    return out


def _bundled(groups: DataFrame, capacity: int) -> DataFrame:
    """``key, bundle, base, n, bytes`` of each ``key, n, bytes``: the bundle it enters and the rows ahead of it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n, sizes = table.column("n").to_numpy(), table.column("bytes").to_numpy()
        bins = np.array(best_fit_decreasing(sizes.tolist(), capacity))
        order = np.argsort(bins, kind="stable")
        ahead = np.cumsum(n[order]) - n[order]
        first = np.searchsorted(bins[order], bins[order])
        base = np.empty(len(n), np.int64)
        base[order] = ahead - ahead[first]
        bundle = (TaskContext.get().partitionId() << 32) + bins
        yield from pa.table({"key": table.column("key"), "bundle": bundle, "base": base, "n": n, "bytes": sizes}).to_batches(max_chunksize=20_000)

    return groups.select("key", "n", "bytes").mapInArrow(run, f"key {dict(groups.dtypes)['key']}, bundle long, base long, n long, bytes long")


def _sums(bundled: DataFrame) -> DataFrame:
    return bundled.groupBy("bundle").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def bundles(groups: DataFrame, many: int, capacity: int, per_task: int, most_tasks: int) -> DataFrame:
    """``key, bundle, base, n, bytes`` for the groups, bundled until at most ``most_tasks`` tasks have made the bundles."""
    tasks = max(1, -(-many // per_task))
    bundled = written(_bundled(groups.repartition(tasks, "key"), capacity), "bundles")
    while tasks > most_tasks:
        lower = _sums(bundled).withColumnRenamed("bundle", "key")
        tasks = min(tasks - 1, max(1, -(-lower.count() // per_task)))
        upper = _bundled(lower.repartition(tasks, "key"), capacity).select(F.col("key").alias("_lower"), F.col("bundle").alias("_bundle"), F.col("base").alias("_base"))
        moved = bundled.join(upper, bundled["bundle"] == upper["_lower"])
        bundled = written(moved.select("key", F.col("_bundle").alias("bundle"), (F.col("_base") + F.col("base")).alias("base"), "n", "bytes"), "bundles")
    return bundled


def shard(documents: DataFrame, shards: int = 40, per_task: int = GROUPS_PER_TASK, most_tasks: int = MOST_TASKS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row of ``doc_id, text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32")
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    slim = written(slim, "sizes")
    parts = slim.groupBy("key", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = parts.withColumn("ahead", F.sum("n").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    parts = written(parts, "parts")
    groups = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    total, many = parts.agg(F.sum("bytes"), F.count("*")).first()
    bundled = bundles(groups, many, max(1, -(-(total or 0) // (shards * BUNDLES_PER_SHARD))), per_task, most_tasks)
    rows = _sums(bundled).orderBy("bundle").collect()
    places, taken = [], [0] * shards
    for r, s in zip(rows, place_bundles([r["bytes"] for r in rows], shards)):
        places.append((r["bundle"], s, taken[s]))
        taken[s] += r["n"]
    placed = F.broadcast(documents.sparkSession.createDataFrame(places, "bundle long, shard int, bundle_base long"))
    start = bundled.join(placed, "bundle").select(F.col("key").alias("_key"), "shard", (F.col("bundle_base") + F.col("base")).alias("group_base"))
    salted = parts.join(start, parts["key"] == start["_key"]).select("key", "salt", "shard", (F.col("group_base") + F.coalesce("ahead", F.lit(0))).alias("start"))
    rank = F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id")) - 1
    return slim.join(salted, ["key", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + rank).alias("slot"))
