import re
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import edge
import numpy as np

from lockstep.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        old, new = (Counter(tuple(r) for r in x.collect()) for x in (before, after))
        assert set(new) <= set(old) and new
        assert all(n <= (2 if name.startswith("mixing") else 1) * old[r] for r, n in new.items())
        before = after
    packed = edge.plain(corpus_pipeline.STAGES[3][1](spark, before, SF))
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r.doc_id for r in before.collect())
    whole = edge.plain(corpus_pipeline.run(spark, SF))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def plain_groups(rows):
    """Groups of ids under links of 0.8 of five-word shingles (fewer words: the sequence), by all pairs."""
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    groups = defaultdict(set)
    for i in sets:
        groups[top(i)].add(i)
    return groups


def test_first_stages_against_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(docs, labels)
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    rows = good.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if model.score(np.array([quality.features(r.text or "")]))[0] >= 0.7}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, good, SF).collect()}
    groups = plain_groups(rows)
    assert set(groups) <= kept and len(kept) - len(groups) <= 0.1 * (len(rows) - len(groups))


def test_odd_rows_pass_through(spark, docs):
    labels_dir = SF
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, labels_dir).cache()
    out.count()
    none = edge.empty(spark, docs)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, labels_dir)
    assert none.count() == 0
