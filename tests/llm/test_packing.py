import random
import zlib
from array import array
from collections import defaultdict

import edge
import numpy as np
import pytest
from tokenizers import Tokenizer

from lockstep.llm import packing
from lockstep.llm.queries import RANKS, VOCABULARY
from lockstep.sources.shared import written


def exact_bins(sizes, capacity):
    """The least number of bins, by trying all ways."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacity}.values():
            place(i + 1, [b + sizes[i] * (j == k) for j, b in enumerate(bins)])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_bounds_and_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 25) for _ in range(rng.randrange(1, 10))]
    least = exact_bins(sizes, 24)
    bins, offsets, fill = packing.best_fit_decreasing(np.array(sizes), 24)
    assert packing.lower_bound(np.bincount(sizes, minlength=25), 24) <= least <= len(fill) <= least + 2
    assert all(sum(s for s, b in zip(sizes, bins) if b == k) == fill[k] <= 24 for k in range(len(fill)))


def check(rows, docs):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    tokenizer, wanted = Tokenizer.from_file(VOCABULARY), defaultdict(list)
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        wanted[doc] += [(k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    return len(bins), sum(x[2] for v in wanted.values() for x in v)


def test_documents(spark, docs):
    rows = edge.plain(packing.pack_documents(docs, RANKS, VOCABULARY))
    n, tokens = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= -(-tokens // 1024) + 2
    assert edge.plain(packing.pack_documents(edge.empty(spark, docs), RANKS, VOCABULARY)) == []


def test_exchange_between_partitions(spark):
    rng = random.Random(5)
    items = [(i, 0, 0, rng.choice((700, 600, 513, 400, 300, 100, 50, 7)), 0) for i in range(4000)] + [(9999, 0, 0, 1024, 0)] * 2
    pieces = written(spark.createDataFrame(items, packing.PIECES), "test")
    placed, facts = packing.pack(pieces, per_partition=300)
    rows = edge.plain(placed)
    assert len(rows) == 4002 and len({r["sequence_id"] for r in rows}) == facts["sequences"]
    alone = sum(len(packing.best_fit_decreasing(np.array([x[3] for x in items[k::14]]), 1024)[2]) for k in range(14))
    assert facts["bound"] <= facts["sequences"] <= facts["bound"] * 1.005 + 1 and facts["sequences"] <= alone


def test_a_million_blanks(spark):
    texts = [" " * 1_000_000 + "x", "a" + "\n" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Tokenizer.from_file(VOCABULARY)
    want = {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}
    found = {}
    for r in edge.plain(packing.pack_documents(df, RANKS, VOCABULARY)):
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == want
