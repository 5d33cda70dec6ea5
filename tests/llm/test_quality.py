import itertools
import math
import random
import zlib

import edge
import numpy as np
import pytest

from lockstep.llm import quality
from lockstep.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_features_are_finite():
    for t in ("", " ", "\n\n", "a", "🙂" * 10, "x" * 200_000, "A B. C|D $%& 12\n\n12"):
        x = quality.features(t)
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def test_learns_shapes_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((np.abs(x[:, 0]) < 0.5) & (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (1, 2) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    flat = quality.fit(x, np.ones(3000))
    assert len(set(flat.score(x))) == 1 and flat.score(x)[0] > 0.99
    assert quality.fit(np.empty((0, 4)), np.empty(0)).score(x[:2]).tolist() == [0.5, 0.5]


def plain_fit(x, y, bins, rounds, rate, pairs, pair_bins, pair_rounds, ridge):
    """The fit written out row by row and cut by cut; the log odds of each row."""
    n, width = len(y), len(x[0])
    mean = (sum(y) + 0.5) / (n + 1)
    total = [math.log(mean / (1 - mean))] * n

    def binned(j, k):
        column = sorted(r[j] for r in x)
        cuts = {column[math.floor(i * (n - 1) / k)] for i in range(1, k)} - {column[0]}
        return [sum(r[j] >= c for c in cuts) for r in x], len(cuts) + 1

    def sums(cells, wanted):
        rows = [r for r in range(n) if cells[r] in wanted]
        p = [1 / (1 + math.exp(-total[r])) for r in rows]
        return sum(y[r] - q for r, q in zip(rows, p)), sum(q * (1 - q) for q in p)

    def worth(found):
        return found[0] ** 2 / (found[1] + ridge)

    def add(cells, groups):
        steps = [(g, sums(cells, g)) for g in groups]
        for g, (up, curve) in steps:
            for r in range(n):
                if cells[r] in g:
                    total[r] += rate * up / (curve + ridge)

    def quadrants(a, b):
        (ca, na), (cb, nb) = coarse[a], coarse[b]
        cells = list(zip(ca, cb))
        parts = {c: sums(cells, {c}) for c in itertools.product(range(na), range(nb))}
        whole = worth([sum(v[i] for v in parts.values()) for i in (0, 1)])
        best = (0.0, [set(parts)])
        for p, q in itertools.product(range(1, na), range(1, nb)):
            groups = [{c for c in parts if (c[0] < p, c[1] < q) == side} for side in itertools.product((True, False), repeat=2)]
            gain = sum(worth([sum(parts[c][i] for c in g) for i in (0, 1)]) for g in groups) - whole
            if gain > best[0]:
                best = (gain, groups)
        return best[0], cells, best[1]

    fine, coarse = [binned(j, bins) for j in range(width)], [binned(j, pair_bins) for j in range(width)]
    for _, (cells, size) in itertools.product(range(rounds), fine):
        leaves = [range(size)]
        for _ in range(2):
            splits = [(g, g[:k], g[k:]) for g in leaves for k in range(1, len(g))]
            gains = [worth(sums(cells, a)) + worth(sums(cells, b)) - worth(sums(cells, g)) for g, a, b in splits]
            if gains and max(gains) > 1e-9:
                g, a, b = splits[gains.index(max(gains))]
                leaves = [x for x in leaves if x != g] + [a, b]
        add(cells, leaves)
    ranked = sorted((-quadrants(a, b)[0], a, b) for a, b in itertools.combinations(range(width), 2))[:pairs]
    for _, (_, a, b) in itertools.product(range(pair_rounds), ranked):
        _, cells, groups = quadrants(a, b)
        add(cells, groups)
    return total


@pytest.mark.parametrize("seed", [3, 4])
def test_fit_against_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(122, 3))  # 121 is no multiple of bins: quantiles fall between rows
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(122) < 0.1) | (x[:, 2] > 1)).astype(float)
    size = {"bins": 7, "rounds": 6, "rate": 0.3, "pairs": 2, "pair_bins": 4, "pair_rounds": 3, "ridge": 2.0}
    want = plain_fit(x.tolist(), y.tolist(), **size)
    assert quality.fit(x, y, **size).score(x) == pytest.approx([1 / (1 + math.exp(-t)) for t in want], abs=1e-9)


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500).astype(float)
    m = quality.fit(x, y, rounds=10, pair_rounds=5)
    for row in x[:20]:
        total = m.intercept + sum(t[np.searchsorted(c, v, "right")] for t, c, v in zip(m.tables, m.cuts, row))
        total += sum(g[np.searchsorted(m.coarse[i], row[i], "right"), np.searchsorted(m.coarse[j], row[j], "right")] for (i, j), g in zip(m.pairs, m.grids))
        assert m.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_whole_tables(spark, docs):
    rng = random.Random(2)
    junk = [(5000 + i, " ".join(rng.choice(("AAA!!", "BB$$$", "CC###")) for _ in range(50))) for i in range(60)]
    both = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame(junk, "doc_id long, text string").withColumn("score", F.lit("clash")))
    labels = [(r.doc_id, 0 if r.doc_id and r.doc_id >= 5000 else 1) for r in both.collect()] + [(5000, None), (None, 1), (5001, 7)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(both, table)
    found = edge.plain(quality.scored(both, model).withColumn("held_out", quality.held_out(F.col("doc_id"))))
    assert len(found) == both.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None} == {True}
    assert all(r["score"] < 0.5 for r in found if r["doc_id"] and r["doc_id"] >= 5000 and r["held_out"])
    again = {r["doc_id"]: r["score"] for r in edge.plain(quality.scored(both.repartition(3), quality.train(both.repartition(7), table)))}
    assert all(again[r["doc_id"]] == r["score"] for r in found if r["doc_id"] != 1200)
    assert edge.plain(quality.scored(edge.empty(spark, both), quality.train(edge.empty(spark, both), table))) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
