import random
import re
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest

from lockstep.llm import mixing


def plain_targets(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, dict.fromkeys(names, 0.0), share * sum(sizes.values())
    free = {s for s in names if sizes[s]}
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, g in give.items():
            room = 2 * sizes[s] - target[s]
            target[s] += min(g, room)
            left += max(0.0, g - room)
            if g >= room:
                free.discard(s)
    return target


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, "é": 3, None: 50, "": 7, "zero": 0, "Z": 400}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()] + [("a", 0)], "source string, size long")
    found = {r["source"]: r["target"] for r in edge.plain(mixing.targets(df))}
    want = plain_targets(sizes)
    assert set(found) == set(want) and all(found[s] == pytest.approx(want[s], abs=1e-6) for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000])
def test_flight_balances(n):
    rng = random.Random(n)
    size = sorted((rng.randrange(1, 300) for _ in range(n)), reverse=True)
    p = mixing.settle_large(size, [0.37] * n, "a")
    p = mixing.fly(size, p, "b")
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(x * s for x, s in zip(p, size)) == pytest.approx(0.37 * sum(size), rel=1e-6)
    assert set(mixing.land(size, p)) <= {0.0, 1.0}


def test_flight_keeps_the_probabilities():
    size = sorted(range(3, 40, 3), reverse=True)
    runs = [mixing.fly(size, mixing.settle_large(size, [0.3] * len(size), f"a{i}"), f"b{i}") for i in range(3000)]
    assert np.abs(np.mean(runs, axis=0) - 0.3).max() < 0.04


def test_documents(spark, docs):
    rng = random.Random(4)
    more = spark.createDataFrame([(9000 + i, edge.prose(rng, rng.randrange(1, 120)), f"src{i % 7}") for i in range(900)], "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").unionByName(more)
    rows = both.collect()
    size_of = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    totals, found = Counter(), edge.plain(mixing.mix(both))
    for r in rows:
        totals[r.source] += size_of[r.doc_id]
    want, source = plain_targets(totals), {r.doc_id: r.source for r in rows}
    assert Counter(r["doc_id"] for r in found) == Counter(r.doc_id for r in rows)
    taken = defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in ("src3", "src4", "src5", "src6"):
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 5
    again = Counter((r["doc_id"], r["taken"]) for r in edge.plain(mixing.mix(both.repartition(9))))
    assert again == Counter((r["doc_id"], r["taken"]) for r in found)
    assert edge.plain(mixing.mix(edge.empty(spark, both))) == []
    whole = edge.plain(mixing.mixed(both))
    words = Counter()
    for r in whole:
        words[r["source"]] += size_of[r["doc_id"]]
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_blocks_merge_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "MERGED_BLOCKS", 5)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, edge.prose(rng, rng.randrange(1, 60)), "one" if i % 10 else "two") for i in range(2500)], "doc_id long, text string, source string")
    found = edge.plain(mixing.mix(df, share=0.6))
    assert len(found) == 2500
    by = defaultdict(lambda: [0, 0])
    for r in found:
        by[r["source_size"]][0] += r["taken"]
        by[r["source_size"]][1] = r["target"]
    assert all(abs(t - want) < 60 for t, want in by.values())


def test_hot_rows_are_spread(spark, monkeypatch):
    """A third of all rows are one row, a third have one doc_id, a third no doc_id."""
    monkeypatch.setattr(mixing, "COPIES", 300)
    rows = [(1, "one two three", "a")] * 2000 + [(2, f"w{k} x y", "a") for k in range(2000)] + [(None, f"v{k} x y", "a") for k in range(2000)] + [(k, f"u{k} x", "b") for k in range(3, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    seen, real = [], mixing._round
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 500)
    monkeypatch.setattr(mixing, "_round", lambda units, *a: seen.append(max(r["count"] for r in units.groupBy("source_rank", "block").count().collect())) or real(units, *a))
    found = edge.plain(mixing.mix(df, share=0.7))
    assert len(found) == len(rows) and seen[0] < 700
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    by = defaultdict(float)
    for r in found:
        by[r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 0.01 * target + 6 for target, taken in by.items())
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in edge.plain(mixing.mix(df.repartition(3), share=0.7))) == Counter((r["doc_id"], r["size"], r["taken"]) for r in found)
