"""Operator 12, ranked lexical search as an exact inner-product search in sparse ball trees.

A document is the vector of its terms' impacts ``(1000000000 * tf) div (1000 * tf + 8 * m)``, an item the vector of its terms' weights, and the score
their inner product, all in whole numbers. Only terms that some item holds can add to a score, so vectors keep those alone.

Tasks read the vectors in shards of ``SHARD`` documents and build a tree of each: a node is split at the median of the projection on the line between two far
documents, down to leaves of ``LEAF``. A node keeps a centroid c, a radius r and a radius along each axis, and no document below it scores above
``u.c + min(|u| r, sum of u_t r_t)`` for an item u: texts vary in many axes that an item lacks, so the ball alone prunes hardly anything, and its
shadows on the item's axes prune about half of the leaves of the given tables. The axes are stretched by the square root of a term's weight (items shrunk alike, so products stay), as common terms vary most and
weigh least. Bounds are doubles, rounded safely: radii and bounds are raised by far more than the additions can lose, and a node is left out only if its bound is
below the worst score held. Nodes are visited best first from a heap; leaves are scored exactly in 64-bit integers. The best of one shard go on
to the next of the task, so later trees are pruned from their roots; a last ranking joins the tasks' best (``top`` an item and task at most).

Items are taken in blocks of about ``BLOCK_TERMS`` terms, each with a pass over the documents, so what tasks receive is bounded however many items there are.
No document is left out by size or sample, and a hot term is only a long column.

Defined results: null text has no terms; rows of one item_id are one item (null is an id too); every document row is a document, so repeated
rows take ranks of their own; null doc_ids come last among equal scores; items without a scoring document have no row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.encoding import slices
from lockstep.sources.shared import dropped, written

SHARD, LEAF, BLOCK_TERMS = 4096, 64, 16_384
SAFE = 1e-9  # relative; sums of up to a million doubles lose less than 1e-10 of the sum of their sizes
#: Bytes of a term stay, A-Z become a-z, all others (ASCII but for letters and digits) become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Items(NamedTuple):
    """Items as numbered terms: for each its id, its terms' numbers and their weights."""

    ids: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    by_term: np.ndarray


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, found``: the distinct terms of each item."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array([sorted(set(terms(t))) for t in part.column("text").to_pylist()], pa.list_(pa.binary()))], ["item_id", "found"])

    split = items.selectExpr("item_id", "cast(text as string) text").mapInArrow(run, f"item_id {kind}, found array<binary>")
    return split.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """Items with their terms, some at a time, so that a block has about ``block_terms`` terms."""
    found = written(item_terms(items), "items")
    total = found.agg(F.sum(F.size("found"))).first()[0] or 0
    many = -(-total // block_terms)
    for k in range(many):
        yield [(r["item_id"], [bytes(t) for t in r["found"]]) for r in found.filter(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).collect()]
    dropped(found)


def vectors(documents: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf``: each document with its number of terms, and the numbers of those in ``number`` with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    found = terms(text)
                    known = sorted((number[t], tf) for t, tf in Counter(found).items() if t in number)
                    rows.append((len(found), [t for t, _ in known], [tf for _, tf in known]))
                n, term, tf = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Shard(NamedTuple):
    """Documents as rows of a sparse table: where each begins, numbers of terms, impacts, impacts on the stretched axes."""

    begin: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    point: np.ndarray

    def rows(self, which: np.ndarray) -> Shard:
        size = np.diff(self.begin)[which]
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.begin[which] - begin[:-1], size) + np.arange(begin[-1])
        return Shard(begin, self.term[at], self.impact[at], self.point[at])

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Of a value for each entry, the sum of each row (no row is empty)."""
        return np.add.reduceat(each, self.begin[:-1])

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self.sums(self.point * dense[self.term])

    def dense(self, row: int, width: int) -> np.ndarray:
        out, own = np.zeros(width), slice(self.begin[row], self.begin[row + 1])
        out[self.term[own]] = self.point[own]
        return out


class Ball:
    """A node: the centroid on the axes it has, its radius and those along the axes, and two children or a leaf's documents."""

    def __init__(self, shard: Shard, which: np.ndarray, width: int, leaf: int):
        own = shard.rows(which)
        center = np.bincount(own.term, own.point, width) / len(which)
        norms, norm = own.sums(own.point**2), float(center @ center)
        gaps = norms - 2 * own.times(center) + norm
        self.children, self.which = (), which
        self.radius = math.sqrt(max(0.0, float((gaps + SAFE * (norms + norm)).max()))) * (1 + SAFE)
        most = np.zeros(width)
        np.maximum.at(most, own.term, own.point)
        self.axes = np.flatnonzero(most)
        self.center, self.reach = center[self.axes], (most - center)[self.axes]
        if len(which) > leaf:
            far = own.dense(int(gaps.argmax()), width)
            other = own.dense(int((norms - 2 * own.times(far)).argmax()), width)
            along = np.argsort(own.times(far - other), kind="stable")
            half = len(which) // 2
            self.children = tuple(Ball(shard, np.sort(which[x]), width, leaf) for x in (along[:half], along[half:]))
        else:
            self.known, column = np.unique(own.term, return_inverse=True)
            self.table = np.zeros((len(self.known), len(which)), np.int64)
            self.table[column, np.repeat(np.arange(len(which)), np.diff(own.begin))] = own.impact

    def bound(self, term: np.ndarray, shrunk: np.ndarray, norm: float) -> float:
        at = np.minimum(np.searchsorted(self.axes, term), len(self.axes) - 1)
        u = np.where(self.axes[at] == term, shrunk, 0.0)
        return (float(self.center[at] @ u) + min(norm * self.radius, float(self.reach[at] @ u))) * (1 + SAFE) + 1

    def scores(self, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, term), len(self.known) - 1)
        met = self.known[at] == term
        return weights[met] @ self.table[at[met]]


def search(root: Ball, ids: list[int | None], term: np.ndarray, weights: np.ndarray, shrunk: np.ndarray, held: list[tuple], top: int) -> tuple[list[tuple], int]:
    """The best of those held and a tree's documents, as ``(-score, no id, id)`` in order; and how many leaves were scored."""
    norm, leaves = math.sqrt(float(shrunk @ shrunk)) * (1 + SAFE), 0
    queue = [(-root.bound(term, shrunk, norm), 0, root)]
    pushed = 1
    while queue:
        bound, _, node = heapq.heappop(queue)
        worst = -held[-1][0] if len(held) == top else 1
        if -bound < worst:
            break
        if node.children:
            for child in node.children:
                heapq.heappush(queue, (max(bound, -child.bound(term, shrunk, norm)), pushed, child))
                pushed += 1
            continue
        leaves += 1
        scores = node.scores(term, weights)
        better = np.flatnonzero(scores >= worst)
        if len(better):
            own = [ids[i] for i in node.which[better]]
            held = sorted([*held, *((-int(s), d is None, d or 0) for s, d in zip(scores[better], own, strict=True))])[:top]
    return held, leaves


def tree_of(begin: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, stats: tuple[int, int], by_term: np.ndarray, leaf: int = LEAF) -> Ball:
    """The ball tree of some documents; ``stats``: how many documents and terms there are in all, ``by_term``: each term's weight."""
    m = np.repeat(10 + 90 * n * stats[0] // stats[1], np.diff(begin))
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
    return Ball(Shard(begin, term, impact, impact * stretch(by_term)[term]), np.arange(len(n)), len(by_term), leaf)


def stretch(by_term: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(by_term, 1).astype(float))


def _best(index: DataFrame, items: Items, stats: tuple[int, int], top: int, shard: int, leaf: int) -> DataFrame:
    """``item, doc_id, score``: the best of each task; ``item`` is the place in ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_axes = stretch(items.by_term)
        shrunk = [w / long_axes[t] for t, w in zip(items.terms, items.weights, strict=True)]
        held: list[list[tuple]] = [[] for _ in items.ids]
        rows: list[pa.RecordBatch] = []

        def searched() -> None:
            table = pa.Table.from_batches(rows).combine_chunks()
            rows.clear()
            term = table.column("term").chunk(0)
            begin = term.offsets.to_numpy().astype(np.int64)
            tf = table.column("tf").chunk(0).flatten().to_numpy().astype(np.int64)
            ids = table.column("doc_id").to_pylist()
            root = tree_of(begin - begin[0], term.flatten().to_numpy(), tf, table.column("n").to_numpy(), stats, items.by_term, leaf)
            for k in range(len(items.ids)):
                if len(items.terms[k]):
                    held[k], _ = search(root, ids, items.terms[k], items.weights[k], shrunk[k], held[k], top)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows.append(batch.slice(at, shard - sum(r.num_rows for r in rows)))
                at += rows[-1].num_rows
                if sum(r.num_rows for r in rows) == shard:
                    searched()
        if rows:
            searched()
        out = [(k, None if none else d, -s) for k, best in enumerate(held) for s, none, d in best]
        yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate((("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())))})

    return index.filter(F.size("term") > 0).mapInArrow(run, "item int, doc_id long, score long")


def rank(documents: DataFrame, items: DataFrame, top: int = 10, shard: int = SHARD, leaf: int = LEAF, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best rows of ``documents(doc_id, text)`` for each item of ``items(item_id, text)``."""
    spark, kind = documents.sparkSession, dict(items.dtypes)["item_id"]
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items, block_terms):
        number = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        index = written(vectors(documents, number).filter("n > 0"), "vectors")
        n_documents, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not number or not n_documents:
            dropped(index)
            continue
        df = np.zeros(len(number), np.int64)
        for r in index.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            df[r["t"]] = r["count"]
        by_term = np.array([weight(n_documents, int(x)) for x in df], np.int64)
        own = [np.array(sorted(number[t] for t in x), np.int64) for _, x in block]
        own = [x[df[x] > 0] for x in own]
        block_items = Items([i for i, _ in block], own, [by_term[x] for x in own], by_term)
        best = written(_best(index, block_items, (n_documents, n_terms), top, shard, leaf), "best")
        dropped(index)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(block_items.ids)], f"item int, item_id {kind}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())).alias("rank")
        ranked = best.select("item", "doc_id", "score", place).filter(F.col("rank") <= top)
        found = found.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: a row an item of the block
    return found
