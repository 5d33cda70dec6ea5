"""Operator 13, filter interaction audit by min-plus removal ranks.

What five filters do in every order depends on a document only through its mask: which of them it fails. So documents are counted by
part and mask (32 at most) and, of those, by label; all else works on these counts. With M the masks by filters (0 where a mask fails a filter,
infinity else) and P the filters by orders (the step at which an order applies a filter: its inverse permutation), the min-plus product
``R[m, o] = min over f of M[m, f] + P[f, o]`` is the step at which order o removes documents of mask m, or infinity. Counts scattered by R, with
weight 1 or a label's, give what each step removes; a filter's failures less what it removes are those removed before it.

Filter E (a copy of a smaller doc_id's text) needs the least doc_id of each text: an aggregation over 256-bit digests, which combines before its shuffle, joined
back by digest for the texts that several ids hold; both sides are plain shuffles, so a text with a third of all rows can be split.

Defined results: null text is empty; a null lang is the part of the empty string; a null doc_id is neither smaller nor larger than any, so its row is never
a copy and makes none; every repeated row counts, and rows that share the least doc_id of a text are no copies of each other; labels may repeat
(the largest holds) or be missing (no label); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lockstep.sources.shared import written

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: filters A to D fail this text."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals.cast("long") > 10 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(documents: DataFrame) -> DataFrame:
    """``part, doc_id, mask`` of each row of ``doc_id, lang, text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    slim = documents.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))
    slim = written(slim, "masks")
    least = slim.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("of", "first")
    met = slim.join(least, F.col("digest") == F.col("of"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("part", "doc_id", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def removal_steps(n_filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of the filters, and R: for each mask and order the step (from 0) that removes, ``n_filters`` if none does."""
    orders = list(permutations(range(n_filters)))
    position = np.argsort(np.array(orders), axis=1)
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    blocked = np.where(fails == 1, 0, n_filters)
    return orders, np.minimum((blocked[:, None, :] + position[None, :, :]).min(axis=2), n_filters)


def audit_of_counts(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int = len(FILTERS)) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """The orders, and ``COUNTS`` as tables of order and step, from documents by mask."""
    orders, steps = removal_steps(n_filters)
    order, at = np.array(orders), np.arange(len(orders))

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), n_filters + 1), np.int64)
        np.add.at(out, (np.broadcast_to(at, steps.shape), steps), np.broadcast_to(weight[:, None], steps.shape))
        return out[:, :n_filters]

    removed, bits = scattered(counts), 1 << np.arange(n_filters)
    fails = np.array([counts[np.arange(len(counts)) & b > 0].sum() for b in bits])
    shapley = np.zeros(n_filters, np.int64)
    np.add.at(shapley, order, removed)
    return orders, {
        "kept": counts.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[order] - removed, "unique_fails": counts[bits][order],
        "good_lost": scattered(good), "toxic_lost": scattered(toxic), "shapley": shapley[order],
    }


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``REPORT``: one row a part, order of the five filters and step. ``labels``: doc_id, quality, toxic."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    met = masks(documents).join(known, F.col("doc_id") == F.col("labelled"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = met.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("held").to_pylist(), strict=True):
                table = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for r in rows:
                    table[:, r["mask"]] = r["n"], r["good"], r["toxic"]
                orders, found = audit_of_counts(*table)
                many = len(FILTERS)
                names = [x for o in orders for x in ["".join(FILTERS[f] for f in o)] * many]
                yield pa.RecordBatch.from_pydict({"part": [part] * len(names), "filter_order": names, "step": pa.array(list(range(1, many + 1)) * len(orders), pa.int32())} | {c: found[c].ravel() for c in COUNTS})

    return held.mapInArrow(run, StructType.fromDDL(REPORT))
