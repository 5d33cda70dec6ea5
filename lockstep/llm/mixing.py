"""Operator 9, mixing sources to target weights by balanced sampling (cube method).

A source's share is ``ratio = target / size``; each of its documents is taken ``floor(ratio)`` times, and once more with probability
``ratio - floor(ratio)``. The cube method decides the latter: it moves the vector of probabilities within the null space
of two balancing equations (expected documents and expected words) until nearly all are 0 or 1. Three undecided documents are moved
at a time, so a step is a cross product. Flights run in blocks of one source; the at most two documents that each leaves meet in
the next round's blocks, until one block is left for each source, whose last documents land on the side that keeps the words closest.
Before that, a block's largest documents are decided one by one, each against all smaller ones at once (a dense direction of the
same null space): a window of three would carry the largest to the end, and small ones shall be left to land.

All random choices are seeded by source rank, round and block, and blocks are dealt by hash of the row, so reruns agree. Rows that are equal in all
are counted and dealt by their number, ``COPIES`` at a time, as they are interchangeable: a row that a third of all repeat fills as many blocks as others do.
Defined results: null text has size 0 and is never taken; a null source is a source, last in order; a source without words has
target 0; repeated rows count and are taken by themselves; null doc_ids are allowed; an empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.rows import row_key, times
from lockstep.sources.shared import written

BLOCK_ROWS, MERGED_BLOCKS, COPIES = 8192, 2048, 65_536
BROADCAST_SOURCES = 10_000
UNITS = "_key long, doc_id long, source_rank long, block long, blocks long, size long, p double"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_rank, source_size, rows, target`` from ``source, size`` (and ``many``, how many rows are so); one row for each source.

    The targets share ``share`` of all words by weight and stop at ``most`` times their source; what is above is shared anew
    among the others by weight. That is one common level: ``least(most * size, level * weight)``.
    """
    many = F.col("many") if "many" in sizes.columns else F.lit(1)
    per = written(sizes.groupBy("source").agg(F.sum(F.col("size") * many).alias("source_size"), F.sum(many).alias("rows")), "sources")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ranked = written(per.select("source", rank.alias("source_rank"), weight.alias("weight"), "source_size", "rows"), "sources")
    goal = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap, level, capped = most * F.col("source_size"), 0.0, -1
    while True:
        below = cap <= level * F.col("weight")
        n, full, free = ranked.agg(F.count_if(below), F.sum(F.when(below, cap)), F.sum(F.when(~below, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (goal - (full or 0.0)) / free
    target = F.when(below, cap).otherwise(level * F.col("weight"))
    return ranked.select("source", "source_rank", "source_size", "rows", target.alias("target"))


def settle_large(size: list[int], p: list[float], seed: str, most: int = 256, tries: int = 20) -> list[float]:
    """Decides the first ``most`` units of a descending order, moving all later ones a little each time."""
    chance, sizes, at = random.Random(seed).random, np.array(size, float), np.array(p, float)
    for i in range(min(most, len(p) - 3)):
        for attempt in range(tries):
            rest = i + 1 + np.flatnonzero((at[i + 1 :] > 0) & (at[i + 1 :] < 1))
            if not 0 < at[i] < 1 or len(rest) < 3:
                break
            s, give = sizes[rest], at[rest] * (1 - at[rest])  # a unit near an end moves little, so steps are long
            n, s1, s2 = give.sum(), (give * s).sum(), (give * s * s).sum()
            if attempt < tries // 2 and n * s2 - s1 * s1 > 1e-9 * n * s2:
                slope = (n * sizes[i] - s1) / (n * s2 - s1 * s1)
                move = -give * ((1 - slope * s1) / n + slope * s)
            else:  # where balancing documents too leaves no long step: words alone
                move = -give * s * (sizes[i] / s2)
            who, way = np.append(rest, i), np.append(move, 1.0)
            use = np.abs(way) > 1e-15
            who, way = who[use], way[use]
            ahead = np.where(way > 0, (1 - at[who]) / way, -at[who] / way).min()
            back = np.where(way > 0, at[who] / way, (at[who] - 1) / way).min()
            at[who] += way * (ahead if chance() * (ahead + back) < back else -back)
            at[at < 1e-9], at[at > 1 - 1e-9] = 0.0, 1.0
    return at.tolist()


def fly(size: list[int], p: list[float], seed: str) -> list[float]:
    """The flight phase over units in their order: at most two stay between 0 and 1."""
    chance, p = random.Random(seed).random, list(p)
    window: list[int] = []
    for unit in range(len(p)):
        if not 0 < p[unit] < 1:
            continue
        window.append(unit)
        if len(window) == 3:
            a, b, c = window
            move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            _step(p, window, move if any(move) else (1, -1, 0), chance)
            window = [i for i in window if 0 < p[i] < 1]
    if len(window) == 2 and size[window[0]] == size[window[1]]:
        _step(p, window, (1, -1), chance)
    return p


def _step(p: list[float], window: list[int], move: tuple[int, ...], chance) -> None:
    """Moves along the direction or against it, as far as one unit allows, with the chances that keep the means."""
    ahead = min((1 - p[i]) / m if m > 0 else -p[i] / m for i, m in zip(window, move) if m)
    back = min(p[i] / m if m > 0 else (p[i] - 1) / m for i, m in zip(window, move) if m)
    by = ahead if chance() * (ahead + back) < back else -back
    decided = False
    for i, m in zip(window, move):
        p[i] += by * m
        if p[i] < 1e-9 or p[i] > 1 - 1e-9:
            p[i], decided = float(round(p[i])), True
    if not decided:  # rounding kept every unit inside: the nearest to an end is decided
        i = min((i for i, m in zip(window, move) if m), key=lambda i: min(p[i], 1 - p[i]))
        p[i] = float(round(p[i]))


def land(size: list[int], p: list[float]) -> list[float]:
    """Decides what a last flight leaves (two units at most) so that the words stay as close as they can."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    if not left:
        return p
    wanted = sum(p[i] * size[i] for i in left)
    sides = [[float(code >> k & 1) for k in range(len(left))] for code in range(1 << len(left))]
    best = min(sides, key=lambda s: (abs(sum(x * size[i] for x, i in zip(s, left)) - wanted), s))
    out = list(p)
    for i, x in zip(left, best):
        out[i] = x
    return out


def _round(units: DataFrame, seed: int, turn: int) -> DataFrame:
    def run(block: pa.Table) -> pa.Table:
        size, p = block.column("size").to_pylist(), block.column("p").to_pylist()
        ids, keys = block.column("doc_id").to_pylist(), block.column("_key").to_pylist()
        order = sorted(range(len(size)), key=lambda i: (-size[i], keys[i], ids[i] is None, ids[i] or 0))
        size, p = [size[i] for i in order], [p[i] for i in order]
        chances = f"{seed} {turn} {block.column('source_rank')[0]} {block.column('block')[0]}"
        p = fly(size, settle_large(size, p, chances), chances)
        if block.column("blocks")[0].as_py() == 1:
            p = land(size, p)
        block = block.take(pa.array(order))
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p))

    return units.groupBy("source_rank", "block").applyInArrow(run, UNITS)


def sample(units: DataFrame, most_blocks: int, seed: int) -> DataFrame:
    """``UNITS`` with every ``p`` decided."""
    names = [c.split()[0] for c in UNITS.split(", ")]
    decided, turn = [], 0
    while True:
        flown = written(_round(units, seed, turn), "flight")
        inside = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.filter(~inside))
        if most_blocks <= 1:
            break
        most_blocks, turn = -(-most_blocks // MERGED_BLOCKS), turn + 1
        units = flown.filter(inside).withColumn("block", F.floor(F.col("block") / MERGED_BLOCKS)).withColumn("blocks", F.ceil(F.col("blocks") / MERGED_BLOCKS)).select(names)
    out = decided[0]
    for df in decided[1:]:
        out = out.unionByName(df)
    return out


def numbered(alike: DataFrame) -> DataFrame:
    """Each row as often as ``many`` says, with ``copy`` from 0; copies of one row are made by several tasks."""
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / COPIES))))
    if (alike.agg(F.max("many")).first()[0] or 0) > COPIES:
        parts = parts.repartition("_key", "part")
    last = F.least(F.col("many"), (F.col("part") + 1) * COPIES) - 1
    return parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last))).drop("many", "part")


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """``_key, doc_id, size, source_size, target, copies, taken`` of each row of ``doc_id, source, text``."""
    slim = documents.select(row_key(documents).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    alike = written(slim.groupBy(*slim.columns).agg(F.count("*").alias("many")), "sizes")
    goals = written(targets(alike, weights, share, most), "targets")
    n_sources, most_rows = goals.agg(F.count("*"), F.max("rows")).first()
    right = goals.withColumnRenamed("source", "_source")
    joined = numbered(alike).join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("_source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    units = joined.select("_key", "doc_id", "source_rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_key", "copy"), blocks).alias("block"), blocks.alias("blocks"), "size", F.when(F.col("size") > 0, ratio - whole).otherwise(0.0).alias("p"))
    picked = sample(units, -(-(most_rows or 0) // BLOCK_ROWS), seed)
    facts = goals.select("source_rank", "source_size", "target")
    copies = F.when(F.col("size") > 0, F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0) + F.col("p").cast("long")).otherwise(0).cast("long")
    out = picked.join(F.broadcast(facts) if n_sources <= BROADCAST_SOURCES else facts, "source_rank")
    return out.select("_key", "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(documents: DataFrame, **settings) -> DataFrame:
    """The rows themselves, each as often as the mix takes it."""
    copies = mix(documents, **settings).groupBy("_key", "doc_id").agg(F.sum("copies").alias("_n"), F.count("*").alias("_m")).filter("_n > 0")
    return times(documents, written(copies, "copies"))
