import hashlib
import random
import re
import struct

import edge
import pytest
import xxhash

from lockstep.llm import fingerprints
from lockstep.llm.queries import QUERIES


def order(row):
    return row[0] is None, row[0] or 0, hashed(("s", row[1])), row[1]


def test_edits_against_plain_python(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=order)
    found = edge.plain(fingerprints.fingerprint_edits(docs))
    assert len(found) == len(rows)
    want, prints = {}, {}
    for (d, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        want.setdefault(d, set()).add((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    for r in found:
        assert (r["n_chars"], r["edited_sha256"]) in want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    distinct = {t: next(iter(p)) for t, p in prints.items() if t.split()}
    assert len(set(distinct.values())) == len(distinct)
    assert edge.plain(fingerprints.fingerprint_edits(edge.empty(spark, docs))) == []


def test_next_across_runs(spark):
    ids = [5, 511, 512, 513, 5000, 90_000, 90_001, 10**12, -7]
    df = spark.createDataFrame([(i, f"text of {i} here") for i in ids], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["next_text"] for r in edge.plain(fingerprints.with_next(df))}
    ranked = sorted(ids)
    assert found == {i: f"text of {n} here" for i, n in zip(ranked, [*ranked[1:], ranked[0]])}
    one = spark.createDataFrame([(1, "alone with itself")], "doc_id long, text string")
    assert [(r["near_next"], r["near_edited"] <= 1) for r in edge.plain(fingerprints.fingerprint_edits(one))] == [(1.0, True)]


def hashed(*values):
    """Spark's xxhash64: each value's hash is the next one's seed."""
    seed = 42
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text):
    """Order MinHash written down word by word: numbered k-mers, the two smallest of each part in text order."""
    upper = lambda h: (h % (1 << 64)) >> 27
    words = [hashed(("s", w)) for w in re.findall(r"[^\x20\x09-\x0D]{1,8}", text)]
    mers = [upper(hashed(*(("q", w) for w in words[i : i + 2]))) for i in range(len(words))]
    seen, parts = {}, {}
    for place, m in enumerate(mers):
        number = seen[m] = seen.get(m, -1) + 1
        name = m if not number else upper(hashed(("q", m), ("i", number)))
        parts.setdefault(name >> 31, []).append((name, place))
    out = []
    for part in sorted(parts):
        two = sorted(sorted(parts[part])[:2], key=lambda x: x[1])
        out.append(part << 32 | hashed(*(("q", name) for name, _ in two)) & 0xFFFFFFFF)
    return out


def spark_sketch(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r["i"]: r["s"] for r in edge.plain(fingerprints.sketches(df, "text", "s"))}
    return [rows[i] for i in range(len(texts))]


def test_sketches_against_plain_python(spark, docs):
    rng = random.Random(11)
    texts = sorted({r.text or "" for r in docs.collect()}) + ["la " * 3000, "a b a b a b c", "one", "日本語" * 40, "x" * 5000, " ".join(rng.choice("abc") for _ in range(2000)), "\u00a0 \x1c é"]
    assert spark_sketch(spark, texts) == [plain_sketch(t) for t in texts]


def test_fingerprints_against_plain_python(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=order)
    want = []
    for (d, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        h = len(t) // 2
        own, changed, following = (plain_sketch(x) for x in (t, t[: len(t) - h] + nxt[:h], nxt))
        want.append((d, "".join("%010x" % v for v in own), "".join("%010x" % v for v in changed), likeness(own, changed), likeness(own, following)))
    found = [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in edge.plain(fingerprints.fingerprint_edits(docs))]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_ranges_follow_sparse_ids(spark):
    ids = [k * 1_000_003 for k in range(3000)] + [10**15 + k for k in range(1000)] + [-(10**17)]
    df = spark.createDataFrame([(i, f"text of {i} here") for i in ids], "doc_id long, text string").repartition(4)
    borders = fingerprints.range_borders(fingerprints._keyed(df), 100)
    counts = {}
    for i in ids:
        k = sum(b <= (0, i, hashed(("s", f"text of {i} here"))) for b in borders)
        counts[k] = counts.get(k, 0) + 1
    assert 20 <= len(borders) <= 41 and max(counts.values()) < 400
    found = {r["doc_id"]: r["next_text"] for r in edge.plain(fingerprints.with_next(df, 100))}
    ranked = sorted(ids)
    assert found == {i: f"text of {n} here" for i, n in zip(ranked, [*ranked[1:], ranked[0]])}


def test_hot_ids_are_spread(spark):
    """A third of all rows with one doc_id, a third without any, and many that repeat one row whole."""
    rows = [(7, f"seven {k}") for k in range(1000)] + [(None, f"none {k}") for k in range(600)] + [(9, "the same row")] * 1000 + [(None, "twice without")] * 300 + [(k, f"other {k}") for k in range(100)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = fingerprints._keyed(df)
    cold, repeats = fingerprints._repeats(keyed, fingerprints.written(keyed.select("last", "doc_id", "h"), "keys"), 100)
    assert sorted((r["doc_id"] is None, r["text"], r["more"]) for r in edge.plain(repeats)) == [(False, "the same row", 999), (True, "twice without", 299)]
    borders = fingerprints.range_borders(cold, 100)
    sizes = [r["count"] for r in edge.plain(cold.groupBy(fingerprints._range_of(borders)).count())]
    assert len(borders) >= 12 and max(sizes) < 400 and sum(sizes) == 1702
    ranked = sorted(rows, key=order)
    want = sorted(((d, t, n) for (d, t), (_, n) in zip(ranked, [*ranked[1:], ranked[0]])), key=str)
    found = edge.plain(fingerprints.with_next(df, 100))
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in found), key=str) == want
    assert all((r["own"] == r["next_own"]) == (r["text"] == r["next_text"]) for r in found)


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "POSITION_BITS", 4)
    with pytest.raises(Exception, match="over 2\\*\\*4 words"):
        spark_sketch(spark, ["a b " * 20])


def likeness(a, b):
    filled = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


def test_sensitive_to_edits_repeats_and_order(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    few = list(words)
    for k in rng.sample(range(1000), 10):
        few[k] = "edit"
    many = [w if rng.random() < 0.5 else "x" + w for w in words]
    swapped = words[500:] + words[:500]
    base, *others = spark_sketch(spark, [" ".join(x) for x in (words, few, many, swapped, words + words, ["other" + w for w in words])])
    near = [likeness(base, o) for o in others]
    assert near[0] > 0.85 and near[1] < 0.25 and 0.3 < near[2] < 0.75 and near[3] < 0.9 and near[4] == 0
    assert len(base) == fingerprints.SLOTS


def test_odd_texts(spark):
    texts = ["", " \n", "one", "one one one one", "日本語" * 10, "x" * 50_000, "a b", "b a", "la " * 30_000]
    found = spark_sketch(spark, texts)
    assert found[0] == found[1] == [] and len({tuple(f) for f in found[2:]}) == len(texts) - 2
    assert all(len(f) <= fingerprints.SLOTS and f == sorted(f, key=lambda x: x >> 32) for f in found)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op10_document_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_edited_is_nearer_than_next(spark):
    rows = edge.plain(QUERIES["op10_document_fingerprints"](spark, "/root/testdata/sf0.001"))
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize("text", ["", "a b c"])
def test_text_form(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").transform(lambda d: fingerprints.sketches(d, "t", "s")).select(fingerprints.as_text(fingerprints.F.col("s")).alias("x"), "s").collect()
    assert row.x == "".join("%010x" % v for v in row.s)
