import random
import re
from collections import defaultdict
from itertools import combinations

import edge
import numpy as np
import pytest
import xxhash

from lockstep.llm import simhash
from lockstep.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("text", ["", " \t", "A", "Ä B c\x1cd e", "a b c", "A b C d", "x " * 500, "The  quick\x0bbrown\nfox\u00a0jumps over THE lazy dog É"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(5))
def test_trees_give_all_components(seed):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:8]:
        for _ in range(rng.choice((1, 40))):
            for k in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << k
            values.add(v)
    values = sorted(values)
    want, got = Union(), Union()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                want.link(a, b)
    for a, b in simhash.stars(values, 4):
        got.link(a, b)
    assert [want.root(v) for v in values] == [got.root(v) for v in values]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(500, 500 + k) for k in range(1, 80)] + [(7, 7), (9, 8)]
    want = Union()
    for a, b in edges:
        want.link(a, b)
    found = {r["a"]: r["b"] for r in edge.plain(components(spark.createDataFrame(edges, "a long, b long")))}
    for v in {x for e in edges for x in e}:
        assert found.get(v, v) == want.root(v)
    assert edge.plain(components(spark.createDataFrame([], "a long, b long"))) == []


@pytest.mark.parametrize("rows, most", [(1, 1), (3, 5), (10_000, 1 << 16)])
def test_links_stream_buckets_over_batches(spark, monkeypatch, rows, most):
    monkeypatch.setattr(simhash, "_SENT", most)
    rng = random.Random(12)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(30)}
    union = Union()
    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 4:
            union.link(a, b)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        found = edge.plain(simhash.links(nodes))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    linked = Union()
    for r in found:
        linked.link(r["a"] % (1 << 64), r["b"] % (1 << 64))
    assert {x: linked.root(x) for x in fps} == {x: union.root(x) for x in fps}
    assert edge.plain(simhash.links(nodes.filter("false"))) == []


def test_near_duplicates_against_brute_force(spark, docs):
    rng = random.Random(8)
    base, more = edge.prose(rng, 400).split(), []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(edge.WORDS)
        more.append((2000 + k, " ".join(words)))
    both = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in both.collect()]
    fps, union = sorted({f for _, f in rows}), Union()
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                union.link(a, b)
    least = defaultdict(lambda: None)
    for d, f in rows:
        r = union.root(f)
        least[r] = d if least[r] is None or d is not None and d < least[r] else least[r]
    found = edge.plain(simhash.near_duplicates(both))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found), key=key) == sorted(((d, f, least[union.root(f)]) for d, f in rows), key=key)
    assert edge.plain(simhash.near_duplicates(edge.empty(spark, docs))) == []


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    originals = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((60, 200, 800)))) for _ in range(120)]
    rows, close = list(enumerate(originals)), 0
    for k, text in enumerate(originals[:60]):
        words = text.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows += [(1000 + k, " ".join(words)), (2000 + k, text)]
        close += jaccard(text, rows[-2][1]) >= 0.8
    shared = originals[0].split()[:50]
    rows += [(3000, " ".join(shared + [rng.choice(vocabulary) for _ in range(300)])), (3001, ""), (3002, None), (3003, " "), (None, "unlike all of the others here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    kept = {r["doc_id"] for r in edge.plain(simhash.without_near_duplicates(df))}
    assert set(range(120)) | {3000, 3001, None} <= kept and not kept & (set(range(2000, 2060)) | {3002, 3003})
    assert close > 50 and len(kept & set(range(1000, 1060))) <= 60 - 0.95 * close
    assert simhash.without_near_duplicates(df).columns == df.columns
    assert edge.plain(simhash.without_near_duplicates(edge.empty(spark, df))) == []


def test_large_buckets_keep_their_links():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    words = rng.integers(-(1 << 62), 1 << 62, 2)
    n = 300
    batch = pa.record_batch({"key": np.zeros(n, np.int64), "node": np.arange(n), "own": np.arange(n) % 2 == 0, "x": np.full(n, words[0]) ^ (1 << rng.integers(0, 62, n)), "y": np.full(n, words[1]), "z": np.full(n, words[1])})
    (out,) = simhash._bucket_pairs(iter([batch]), 3, 10)
    union = Union()
    for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist()):
        union.link(a, b)
    assert {union.root(i) for i in range(n)} == {0} and out.num_rows < 2 * n


def test_chained_copies_against_brute_force(spark):
    """Near copies of near copies in one bucket: components are those of all pairs in reach, whatever a dense bucket's first look leaves out."""
    rng = np.random.default_rng(12)
    bits = [rng.integers(0, 2, 512)]
    for _ in range(300):
        v = bits[rng.integers(len(bits))].copy()
        v[rng.choice(512, rng.integers(30, 80), replace=False)] ^= 1
        bits.append(v)
    wide = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    names = rng.permutation(len(bits)).tolist()
    nodes = spark.createDataFrame([(n, w.tolist(), [5]) for n, w in zip(names, wide)], "node long, wide array<long>, keys array<long>")
    want, got = Union(), Union()
    for i, a in enumerate(names):
        for j in range(i):
            if (bits[i] != bits[j]).sum() <= 88:
                want.link(a, names[j])
    for r in edge.plain(simhash.wide_links(nodes, 0.172)):
        got.link(r["a"], r["b"])
    assert [got.root(n) for n in names] == [want.root(n) for n in names]


def test_links_have_the_similarity(spark):
    """Texts of similarity 0.6 to 0.79 to each other stay, and those of 0.8 or more go, in whatever bucket they meet."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, close, apart = [], 0, 0
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((k, " ".join(words)))
        for at in rng.sample(range(10, 190, 6), rng.choice((4, 6, 8))):
            words[at] = rng.choice(vocabulary)
        rows.append((1000 + k, " ".join(words)))
    rows += [(3000, "a b c d"), (3001, "a b c e"), (3002, "A  b c d")]
    kept = {r["doc_id"] for r in edge.plain(simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    for (_, a), (k, b) in zip(rows[:300:2], rows[1:300:2]):
        similarity = jaccard(a, b)
        close, apart = close + (similarity >= 0.8), apart + (similarity < 0.8)
        assert similarity >= 0.8 or k in kept
    assert apart > 50 and close > 30 and len([k for k in kept if 1000 <= k < 3000]) <= apart + 0.05 * close and {3000, 3001} <= kept and 3002 not in kept


@pytest.mark.parametrize("size", [3, 10, 300])
def test_links_do_not_depend_on_the_size_of_a_bucket(spark, size):
    """b is near a, and c near b but far from a; the rest of the bucket is far from all."""
    rng = np.random.default_rng(14)
    a = rng.integers(0, 2, 512)
    b, c = a.copy(), a.copy()
    b[:60] ^= 1
    c[:120] ^= 1
    rest = [rng.integers(0, 2, 512) for _ in range(size - 3)]
    wide = np.packbits([a, b, c, *rest], axis=1, bitorder="little").view("<i8")
    nodes = spark.createDataFrame([(n, w.tolist(), [5]) for n, w in enumerate(wide)], "node long, wide array<long>, keys array<long>")
    assert {(r["a"], r["b"]) for r in edge.plain(simhash.wide_links(nodes, 0.172).distinct())} == {(0, 1), (1, 2)}


def chained(rng, n):
    """Texts in chains of edits, with copies, templates and unrelated ones."""
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice((12, 40, 120, 300)))]
        for _ in range(rng.choice((1, 1, 2, 5, 25))):
            rows.append(" ".join(words))
            words = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice((30, 60, 120)))):
                words[at] = rng.choice(vocabulary)
    return list(enumerate(rows[:n]))


def test_kept_rows_against_brute_force_over_all_pairs(spark):
    """No link below the threshold, at least 0.9 of those above it, and the same rows whatever the number of partitions."""
    rows = chained(random.Random(15), 2500)
    sets = [set(simhash.shingles(t).tolist()) for _, t in rows]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    true = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:  # pairs without a common shingle have no similarity
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                true.add((j, i))
    union = Union()
    for i, j in true:
        union.link(i, j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "7", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        kept.append({r["doc_id"] for r in edge.plain(simhash.without_near_duplicates(df.repartition(5)))})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert kept[0] == kept[1] == kept[2]
    want = {union.root(i) for i, _ in rows}
    assert want <= kept[0] and len(kept[0] - want) <= 0.1 * (len(rows) - len(want))
    found = {r["doc_id"]: r["root"] for r in edge.plain(simhash.near_copies(df))}
    assert sum(found[i] == found[j] for i, j in true) >= 0.95 * len(true)
    for root in set(found.values()):
        assert len({union.root(i) for i, r in found.items() if r == root}) == 1


def test_bounds_change_no_group(spark):
    """Every bucket taken as dense, and cut into small parts, gives the groups that the usual bounds give."""
    rows = chained(random.Random(16), 900)
    rng = random.Random(17)
    base = [f"w{k}" for k in range(160)]
    for k in range(200):  # a family of similarity 0.5 to 0.9
        words = list(base)
        for at in rng.sample(range(160), rng.choice((1, 2, 4, 8, 12))):
            words[at] = f"e{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = [{r["doc_id"]: r["root"] for r in edge.plain(simhash.near_copies(df, **b))} for b in ({}, {"many_near": 1}, {"many_near": 2, "part_rows": 20}, {"many_near": 30})]
    partition = lambda g: sorted(sorted(d for d in g if g[d] == root) for root in set(g.values()))
    assert partition(groups[0]) == partition(groups[1]) == partition(groups[2]) == partition(groups[3])
    sets = {d: set(simhash.shingles(t).tolist()) for d, t in rows if d >= 5000}
    union = Union()
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                union.link(i, j)
    assert sum(len({groups[0][j] for j in sets if union.root(j) == r}) for r in {union.root(i) for i in sets}) <= 1.1 * len({union.root(i) for i in sets})


def test_sets_are_compared_exactly():
    rng = np.random.default_rng(18)
    one = np.unique(rng.integers(0, 1000, 300).astype("<u8"))
    others = [np.unique(np.concatenate([rng.choice(one, rng.integers(1, len(one) + 1), replace=False), rng.integers(1000, 2000, rng.integers(0, 60))]).astype("<u8")) for _ in range(200)] + [np.empty(0, "<u8"), one]
    assert simhash._similar_to(one, others).tolist() == [simhash.similar(one, o) for o in others[:-2]] + [False, True]
    assert not simhash._similar_to(np.empty(0, "<u8"), others).any()
