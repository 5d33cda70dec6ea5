"""Operator 7, SimHash near-dedup with BK-trees.

Each text gives a 64-bit fingerprint: the majority, bit by bit, of the hashes of its word shingles. Equal fingerprints are one node.
Nodes at most ``radius`` bits apart are linked. Of six blocks of bits, four differing bits leave at least two untouched, so
linked nodes meet in at least one of fifteen tables keyed by two blocks. A bucket is a shard: its BK-tree (children keyed by
their Hamming distance to the parent) is built in the task that the bucket is dealt to, and searched along the edges within the
radius only. A node that a search reaches leaves the tree, and branches without remaining nodes are not entered; so a
dense group costs about its size and gives a spanning star, not all its pairs, and no link between components is lost.
Departure from the dealt form: the trees of all shards together grow with the corpus, so they are sent by a shuffle and not broadcast, and the
fifteen tables choose what meets in a tree; a few large broadcast trees would have each fingerprint visit most of their nodes.

Four of 64 bits is a narrow reach: it stands for a similarity of about 0.95. :func:`near_copies` reaches texts whose sets of five-word
shingles have a Jaccard similarity of 0.8. A fingerprint of 512 bits gives candidates: at 0.8, 15 % of bits differ on average, and the reach is 20 %.
No pigeonhole helps there, so candidates come from bands of 20 bits, and each text also probes the buckets that it would have if one or
both of a band's two most nearly tied votes had fallen the other way: it is such bits that an edit turns; the tables above give more. In a
bucket the tree has one level: entries keyed by their distance to the first, and only keys within the reach of each other are compared. This
search is approximate, but each link is confirmed by the exact similarity of the two sets of shingles, in dense buckets and others alike; dense ones of
over ``PART_ROWS`` entries are compared part by part. The README gives the measured recall.

Defined results: null and empty texts (and those of white space alone) have fingerprint zero and are linked like any others; with
fewer words than a shingle has, the whole sequence is one shingle; rows with a null doc_id take part, and a component of only
such rows has a null id; repeated rows share their node; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.components import components
from lockstep.llm.encoding import slices
from lockstep.llm.rows import row_key, times
from lockstep.sources.shared import dropped, written

_PART = 1 << 16  # shingles whose bits are counted at once
_SENT = 1 << 16  # links that a task gathers before it sends them


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    words = text.encode().lower().split()  # both are ASCII-only for bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[last:])], "<u8")
    counts = sum(np.unpackbits(hashes[i : i + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), _PART))
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``_key, doc_id, fp`` (as a signed long) of each row; ``_key`` tells rows of other content apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(t or "", width, seed) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["_key", "doc_id", "fp"])

    slim = documents.select(row_key(documents).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "_key long, doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit numbers whose nodes can be taken out by searches."""

    def __init__(self, values: list[int]):
        self.values, self.up = values, [-1] * len(values)
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.left = [1] * len(values)  # nodes not taken, in each subtree
        self.taken = [False] * len(values)
        for i in range(1, len(values)):
            at, value = 0, values[i]
            while True:
                self.left[at] += 1
                d = (value ^ values[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d], self.up[i] = i, at
                    break
                at = below

    def take(self, i: int) -> None:
        self.taken[i] = True
        while i >= 0:
            self.left[i] -= 1
            i = self.up[i]

    def take_near(self, value: int, radius: int) -> list[int]:
        """Takes out and returns what is left within the radius."""
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.left[at]:
                continue
            d = (value ^ self.values[at]).bit_count()
            if d <= radius and not self.taken[at]:
                found.append(at)
            stack += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        for i in found:
            self.take(i)
        return found


def stars(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect exactly the components of ``values`` under the radius: each node but one with a node reached before."""
    tree = BKTree(values)
    for i, value in enumerate(values):
        if not tree.taken[i]:
            tree.take(i)
            waiting = [i]
            while waiting:
                for j in tree.take_near(values[waiting.pop()], radius):
                    waiting.append(j)
                    yield value, values[j]


def _tables(fp: Column, blocks: int, agreeing: int) -> Column:
    """The bucket keys of a fingerprint: a hash of each choice of ``agreeing`` blocks of its bits."""
    borders = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << k for k in range(a, b)) for a, b in zip(borders, borders[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(sum(chosen))).cast("long"))) for i, chosen in enumerate(combinations(masks, agreeing))))


def links(nodes: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """``a, b``: links between distinct values of ``fp`` that give the components under the radius. A task streams its buckets in order and holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []  # the bucket that is open, its pieces, links to be sent

        def sent() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def closed() -> None:
            if sum(map(len, held)) > 1:
                out.extend(stars(np.unique(np.concatenate(held)).tolist(), radius))
            held.clear()

        for batch in batches:
            bucket, fp = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
            sizes = np.diff(starts, append=len(bucket))
            ends = (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
            for k in np.flatnonzero((sizes > 1) | ends).tolist():  # a bucket of one row in the midst of a batch has no link
                a = int(starts[k])
                if bucket[a] != at:
                    closed()
                    at = bucket[a]
                held.append(fp[a : a + int(sizes[k])])
                if len(out) >= _SENT:
                    yield sent()
        closed()
        yield sent()

    keyed = nodes.select("fp", F.explode(_tables(F.col("fp"), blocks, blocks - radius)).alias("bucket"))
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``_key, doc_id, fp, component_id, root`` of each row; ``root`` is the component's least fingerprint."""
    prints = written(fingerprints(documents, width, seed), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(nodes.select("fp"), radius))
    # what is joined is written first: a join of two plain shuffles can be split where a fingerprint or component holds many rows
    rooted = written(nodes.join(linked, nodes["fp"] == linked["a"], "left").select("fp", F.coalesce("b", "fp").alias("root"), "least"), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = written(rooted.select("fp", "root").join(least, "root"), "named")
    dropped(rooted, least, linked)
    return prints.join(named, "fp").select("_key", "doc_id", "fp", "component_id", "root")


WIDE_WORDS, BANDS, BAND_BITS = 8, 16, 20
BROADCAST_KEYS, MANY_NEAR, PART_ROWS = 100_000, 8, 4096
SIMILAR, REACH = (4, 5), 0.2  # the threshold of the similarity; the share of 512 bits in which candidates may differ
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, (WIDE_WORDS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of the text's distinct shingles, in order; none of a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.sort(np.array(list({digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[last:])}), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have at least the threshold's similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - common)


def wide_votes(hashes: np.ndarray) -> np.ndarray:
    """For each of 512 bits, how many more of the shingles set it than do not."""
    counts = np.zeros((WIDE_WORDS, 64), np.int64)
    for i in range(0, len(hashes), _PART):
        part = hashes[i : i + _PART]
        for k, (a, b) in enumerate(_MULTIPLIERS):
            mixed = part * a
            mixed = (mixed ^ (mixed >> np.uint64(29))) * b
            mixed ^= mixed >> np.uint64(32)
            counts[k] += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * counts.ravel() - len(hashes)


def band_keys(votes: np.ndarray) -> np.ndarray:
    """A row for each band: its own key, then those with its most nearly tied bit, the second such and both turned."""
    used = votes[: BANDS * BAND_BITS].reshape(BANDS, BAND_BITS)
    place = np.int64(1) << np.arange(BAND_BITS)
    own = ((used > 0) * place).sum(1) + (np.arange(BANDS) << BAND_BITS)
    tied = place[np.argsort(np.abs(used), axis=1, kind="stable")[:, :2]]
    return np.stack([own, own ^ tied[:, 0], own ^ tied[:, 1], own ^ tied[:, 0] ^ tied[:, 1]], 1)


def wide_fingerprints(documents: DataFrame) -> DataFrame:
    """``_key, doc_id, fp`` as :func:`fingerprints` gives, with ``wide`` (eight longs), ``keys`` (four a band) and a ``digest`` of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                sets = [shingles(t) for t in texts]
                digests = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64))
                votes = [wide_votes(x) for x in sets]
                wide = [np.packbits(v > 0, bitorder="little").view("<i8") for v in votes]
                lists = [pa.ListArray.from_arrays(np.arange(0, n * len(texts) + 1, n, np.int32), np.concatenate(x)) for n, x in ((WIDE_WORDS, wide), (4 * BANDS, [band_keys(v).ravel() for v in votes]))]
                yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("doc_id"), pa.array(fps), *lists, digests], names=["_key", "doc_id", "fp", "wide", "keys", "digest"])

    slim = documents.select(row_key(documents).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "_key long, doc_id long, fp long, wide array<bigint>, keys array<bigint>, digest long")


def _top(up: dict[int, int], n: int) -> int:
    """The root of a node in a union-find forest; new nodes are their own."""
    while up.setdefault(n, n) != n:
        up[n] = n = up[up[n]]
    return n


def _own(at: Column) -> Column:
    """Whether a node's key of that place is its own: the first of each band's four, and all tables' after them."""
    return (at % 4 == 0) | (at >= 4 * BANDS)


def _sorted_out(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """A partition's columns in order of bucket, then own entries first, then node; each bucket's start and size."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    key, node, own, *rest = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("key", "node", "own", *names))
    order = np.lexsort((node, ~own, key))
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [key, node[order], own[order], *(r[order] for r in rest)], starts, np.diff(np.append(starts, len(key)))


def _pair_batch(pairs: np.ndarray, dense: np.ndarray | None = None) -> pa.RecordBatch:
    """``a, b`` with the smaller first, each pair once; after them, for each dense bucket, its key in ``dense``, with ``a = b``."""
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    if dense is None:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    marks = np.zeros(len(dense), np.int64)
    keys = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(dense, pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(np.append(pairs[:, 0], marks)), pa.array(np.append(pairs[:, 1], marks)), keys], names=["a", "b", "dense"])


def _bucket_pairs(batches: Iterator[pa.RecordBatch], sure: int, reach: int, many_near: int = MANY_NEAR) -> Iterator[pa.RecordBatch]:
    """Pairs within ``reach``, by the last 192 bits, of the entries of a partition's buckets: all of them, but for dense buckets, where
    an entry has over ``many_near``. There an entry surely near an earlier one is not compared further, and of the pairs found only those are given,
    nearest first, that join what the nearer ones do not. This is a first look that costs and gives about a dense bucket's size; such
    buckets are named, and :func:`_crossing_pairs` compares in them whatever the pairs that were confirmed have not joined."""
    found = _sorted_out(batches, ("x", "y", "z"))
    if not found:
        return
    (key, node, own, *words), starts, sizes = found
    words = [w.view(np.uint64) for w in words]
    shared = np.logical_and(own[starts], sizes > 1)  # own entries come first
    apart = lambda i, j: sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
    edge = apart(np.repeat(starts, sizes), np.arange(len(key)))  # the children's keys under each bucket's first entry
    every, first_look, dense = [np.empty((0, 2), np.int64)], [np.empty((0, 3), np.int64)], []
    for size in range(2, many_near + 1):
        first = starts[shared & (sizes == size)]
        for i in range(size - 1):
            at = first[own[first + i]] + i
            for j in range(1, size - i):
                at_j = at[np.abs(edge[at] - edge[at + j]) <= reach]
                hit = at_j[apart(at_j, at_j + j) <= reach]
                every.append(np.stack([node[hit], node[hit + j]], 1))
    for start, size in zip(starts[shared & (sizes > many_near)], sizes[shared & (sizes > many_near)]):
        left, is_dense, pairs = np.arange(start, start + size), False, []
        while len(left) > 1:
            at, left = left[0], left[1:]
            if not own[at]:  # what only probes is compared with own entries, which come first
                break
            follow = np.flatnonzero(np.abs(edge[left] - edge[at]) <= reach)
            d = apart(at, left[follow])
            hit = d <= reach
            if hit.any():
                pairs.append(np.stack([d[hit], np.full(hit.sum(), node[at]), node[left[follow[hit]]]], 1))
            is_dense = is_dense or hit.sum() > many_near
            if is_dense:
                left = np.delete(left, follow[d <= sure])
        if is_dense:
            dense.append(key[start])
            first_look += pairs
        else:
            every += [p[:, 1:] for p in pairs]
    up: dict[int, int] = {}
    for _, p, q in np.unique(np.concatenate(first_look), axis=0).tolist():  # nearest first
        a, b = _top(up, p), _top(up, q)
        if a != b:
            up[a] = b
            every.append(np.array([[p, q]]))
    yield _pair_batch(np.concatenate(every), np.array(dense, np.int64))


def _similar_to(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of the other sets (sorted) has the threshold's similarity with one."""
    sizes = np.array([len(x) for x in others])
    fits = (np.minimum(sizes, len(one)) * SIMILAR[1] >= np.maximum(sizes, len(one)) * SIMILAR[0]) & (sizes > 0)
    which = np.flatnonzero(fits)
    out = fits & False
    if len(which) and len(one):
        flat = np.concatenate([others[k] for k in which])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        common = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[which])[:-1])))
        out[which] = common * SIMILAR[1] >= SIMILAR[0] * (len(one) + sizes[which] - common)
    return out


def _crossing_pairs(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """All pairs of the entries of a partition's buckets within ``reach`` of 512 bits, but for those in one ``group``, which are joined already.
    Entries with their ``shingles`` are compared by these too, exactly and on the spot. Of a bucket in parts (``i < j``) only pairs between two parts."""
    found = _sorted_out(batches, ("group", "shingles", "part", "within", *(f"w{k}" for k in range(WIDE_WORDS))))
    if not found:
        return
    (_, node, _, group, held_sets, part, within, *words), starts, sizes = found
    words = np.stack([w.view(np.uint64) for w in words], 1)
    sets = [np.frombuffer(x, "<u8") for x in held_sets] if held_sets[0] is not None else None
    held, n = [], 0
    for start, size in zip(starts.tolist(), sizes.tolist()):
        _, name, count = np.unique(group[start : start + size], return_inverse=True, return_counts=True)
        order = start + np.lexsort((name, count[name]))  # the largest group last, so its entries are only looked at by others
        ends = np.cumsum(np.sort(count)).tolist()
        for a, b in zip([0, *ends], ends[:-1]):
            others = order[b:]
            for at in order[a:b]:
                hit = others if within[at] else others[part[others] != part[at]]
                hit = hit[np.bitwise_count(words[hit] ^ words[at]).sum(1, dtype=np.int64) <= reach]
                if sets and len(hit):
                    hit = hit[_similar_to(sets[at], [sets[k] for k in hit])]
                if len(hit):
                    held.append(np.stack([np.full(len(hit), node[at]), node[hit]], 1))
                    n += len(hit)
            if n > 1 << 20:
                yield _pair_batch(np.concatenate(held))
                held, n = [], 0
    if held:
        yield _pair_batch(np.concatenate(held))


def in_parts(entries: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """Entries (``key, node, ...``) of buckets, with ``part`` and ``within``: a bucket of over ``rows`` is cut into parts by hash, and each two of its parts meet under a key of their own."""
    sizes = entries.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count("*") / rows).alias("parts")).filter("parts > 1")
    large = written(sizes, "large")
    many = large.count()
    if not many:
        dropped(large)
        return entries.withColumns({"part": F.lit(0).cast("long"), "within": F.lit(True)})
    met = entries.join(F.broadcast(large) if many <= BROADCAST_KEYS else large, F.col("key") == F.col("of"), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return met.withColumns({"key": F.when(F.col("parts") > 1, F.xxhash64("key", low, high)).otherwise(F.col("key")), "within": F.col("part") == F.col("other")}).drop("of", "parts", "other")


def _within(pairs: DataFrame, nodes: DataFrame, reach: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose 512 bits differ in at most ``reach``."""
    left, right = (nodes.select(F.col("node").alias(name), F.col("wide").alias(f"w{name}")) for name in "ab")
    differing = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, z: s + z)
    return pairs.join(left, "a").join(right, "b").filter(differing <= reach).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts (``node, text``) have the threshold's similarity by their sets of five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in slices(whole, "ta"):
                for batch in slices(half, "tb"):
                    a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
                    sets: dict[int, np.ndarray] = {}
                    for names, column in ((a, "ta"), (b, "tb")):
                        for name, text in zip(names, batch.column(column).to_pylist(), strict=True):
                            if name not in sets:
                                sets[name] = shingles(text or "")
                    kept = pa.array([similar(sets[x], sets[y]) for x, y in zip(a, b, strict=True)], pa.bool_())
                    yield batch.select(["a", "b"]).filter(kept)

    left, right = (texts.select(F.col("node").alias(name), F.col("text").alias(f"t{name}")) for name in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sets_of(texts: DataFrame) -> DataFrame:
    """``set_of, shingles``: the set of five-word shingles of each text (``node, text``), as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = pa.array([shingles(t or "").astype("<u8").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["set_of", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "set_of long, shingles binary")


def _texts_of(nodes: DataFrame, wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes (``node``), from one row of each."""
    found = written(nodes.join(wanted, "node", "left_semi").select("node", "row._key", F.col("row.doc_id").alias("doc_id")), "wanted")
    found = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    slim = documents.select(row_key(documents).alias("_k"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    joined = slim.join(found, (F.col("_k") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    return written(joined.select("node", "text").dropDuplicates(["node"]), "texts")


def wide_links(nodes: DataFrame, reach: float = REACH, documents: DataFrame | None = None, many_near: int = MANY_NEAR, part_rows: int = PART_ROWS) -> DataFrame:
    """``a, b``: nodes (``node, wide, keys``) that a bucket brings together and whose fingerprints differ in at most that share of
    bits; with ``documents`` (and a ``row`` of theirs, ``_key, doc_id``, with each node) only those whose sets of shingles have the threshold's similarity.
    By 192 bits, three standard errors more are let pass to the comparison of all 512, and far fewer are enough for a first look.
    A pair is left out only where links that were confirmed join both its ends already. In dense buckets (an entry has over ``many_near``) the sets of
    shingles travel with the entries, since there the pairs would be many more than the links."""
    word = lambda k: F.get("wide", F.lit(k))
    slim = nodes.select("node", "wide", F.posexplode("keys").alias("at", "key")).select("key", "node", _own(F.col("at")).alias("own"), *(word(WIDE_WORDS - 3 + k).alias(name) for k, name in enumerate("xyz")))
    error = 3 * (reach * (1 - reach) / 192) ** 0.5
    sure, rough, whole = round((reach - 0.8 * error) * 192), round((reach + error) * 192), round(reach * 64 * WIDE_WORDS)
    looked = written(slim.repartition("key").mapInArrow(lambda batches: _bucket_pairs(batches, sure, rough, many_near), "a long, b long, dense long").distinct(), "pairs")
    rough_near = written(_within(looked.filter("dense is null").select("a", "b"), nodes, whole), "near")
    texts = documents is not None and _texts_of(nodes, rough_near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), documents)
    near = written(_confirmed(rough_near, texts) if texts else rough_near, "links")
    dropped(rough_near, *([texts] if texts else []))
    dense = looked.filter("dense is not null").select(F.col("dense").alias("key"))
    n_dense = dense.count()
    if not n_dense:
        return near
    joined = components(near).select(F.col("a").alias("node"), F.col("b").alias("group"))
    grouped = nodes.join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    again = grouped.select("node", "group", "wide", F.posexplode("keys").alias("at", "key")).join(F.broadcast(dense) if n_dense <= BROADCAST_KEYS else dense, "key", "left_semi")
    wide = again.select("key", "node", _own(F.col("at")).alias("own"), "group", *(word(k).alias(f"w{k}") for k in range(WIDE_WORDS)))
    wide = written(in_parts(wide, part_rows), "dense")
    if documents is None:
        wide = wide.withColumn("shingles", F.lit(None).cast("binary"))
    else:
        texts = _texts_of(nodes, wide.select("node").distinct(), documents)
        wide = wide.join(_sets_of(texts), F.col("node") == F.col("set_of"))
    crossing = written(wide.repartition("key").mapInArrow(lambda batches: _crossing_pairs(batches, whole), "a long, b long").distinct(), "crossing")
    dropped(looked)
    return near.unionByName(crossing)


def near_copies(documents: DataFrame, radius: int = 4, reach: float = REACH, **bounds) -> DataFrame:
    """``_key, doc_id, root`` of each row: rows of one root are linked by confirmed pairs. Candidates share a band or, as in :func:`links`, blocks of 64 bits.
    ``bounds``: what :func:`wide_links` takes; they change how candidates are compared, not which."""
    prints = wide_fingerprints(documents).withColumn("node", F.xxhash64("fp", "wide", "digest"))
    prints = written(prints.withColumn("keys", F.concat("keys", _tables(F.col("fp"), 6, 6 - radius))), "fingerprints")
    nodes = written(prints.groupBy("node").agg(F.first("wide").alias("wide"), F.first("keys").alias("keys"), F.first(F.struct("_key", "doc_id")).alias("row")), "nodes")
    linked = components(wide_links(nodes, reach, documents, **bounds))
    return prints.join(linked, prints["node"] == linked["a"], "left").select("_key", "doc_id", F.coalesce("b", "node").alias("root"))


def without_near_duplicates(documents: DataFrame, radius: int = 4, reach: float = REACH) -> DataFrame:
    """One whole row of each group of near copies: that of the smallest doc_id."""
    alike = near_copies(documents, radius, reach).groupBy("root", "doc_id", "_key").agg(F.count("*").alias("_m"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_m")).alias("r"))
    return times(documents, written(first.select("r._key", "r.doc_id", F.lit(1).alias("_n"), "r._m"), "kept"))
