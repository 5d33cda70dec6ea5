import random
import zlib
from collections import Counter, defaultdict

import edge
import pytest

from lockstep.llm import sharding


def test_rooms_find_the_tightest():
    rng, rooms, held = random.Random(1), sharding.Rooms(half=4), []
    for step in range(3000):
        if rng.random() < 0.6 or not held:
            held.append((rng.randrange(1, 60), step))
            rooms.add(*held[-1])
        else:
            size = rng.randrange(1, 65)
            want = min((h for h in held if h[0] >= size), default=None)
            assert rooms.tightest(size) == want
            if want:
                held.remove(want)


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    bins = sharding.best_fit_decreasing(sizes, 100)
    fill = Counter()
    for s, b in zip(sizes, bins):
        fill[b] += s
    assert max(fill.values()) <= 100 and len(fill) <= 11 / 9 * -(-sum(sizes) // 100) + 1
    emptiest = sorted(fill.values())[:2]
    assert sum(emptiest) > 100


def test_bundles_spread_and_a_giant_is_alone():
    out = sharding.place_bundles([1000] + [10] * 390, 40)
    assert out.count(out[0]) == 1
    assert max(Counter(out[1:]).values()) - min(Counter(out[1:]).values()) <= 1 and len(set(out)) == 40


def test_documents(spark, docs):
    rows, texts = edge.plain(sharding.shard(docs, 5)), defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert Counter(r["doc_id"] for r in rows) == Counter({k: len(v) for k, v in texts.items()})
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]][0]
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
        slots[r["shard"]].append(r["slot"])
        groups[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values()) and set(slots) <= set(range(5))
    assert edge.plain(sharding.shard(edge.empty(spark, docs))) == []


def test_sizes_are_near_equal(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, edge.prose(rng, rng.randrange(1, 60))) for i in range(6000)], "doc_id long, text string")
    sizes = Counter()
    for r in edge.plain(sharding.shard(df)):
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 40 and max(sizes.values()) < 1.01 * min(sizes.values())


def test_bundles_on_the_driver_stay_bounded(spark):
    rows = [(k, k, 10 + k % 7) for k in range(600)]
    groups = spark.createDataFrame([(b"%d" % k, 1 + k % 3, s) for k, _, s in rows], "key binary, n long, bytes long")
    total = sum(s for _, _, s in rows)
    for per_task in (1, 10, 1000):
        found = sharding.bundles(groups, 600, total // 40, per_task, 4).collect()
        assert len({r["bundle"] for r in found}) <= 2 * 40 + 4 and len(found) == 600
        slots = {}
        for r in found:
            slots.setdefault(r["bundle"], []).extend(range(r["base"], r["base"] + r["n"]))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_levels_of_bundles_keep_every_row(spark, docs):
    rows = edge.plain(sharding.shard(docs, 7, per_task=2, most_tasks=3))
    assert len(rows) == docs.count()
    for s in range(7):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
