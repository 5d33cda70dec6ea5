import re
from collections import Counter
from itertools import permutations

import edge
import numpy as np
import pytest
from oracle import agrees
from pyspark.sql import functions as F

from lockstep.llm import filter_audit, queries


def plain(rows, labels):
    """Each document through each order, filter by filter."""
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, lang, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, *labels.get(d, (0, 0))))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {p for p, *_ in docs}:
        shapley = Counter()
        for o in orders:
            left = [x for x in docs if x[0] == part]
            for k, f in enumerate(o):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                mine = [x for x in docs if x[0] == part and f in x[1]]
                shapley[f] += len(gone)
                out[part, o, k + 1] = [len(left), len(gone), len(mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for o in orders:
            for k, f in enumerate(o):
                out[part, o, k + 1].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark, docs):
    odd = [(2000 + k, t, lang, None) for k, (t, lang) in enumerate([("A B C", None), ("a|b", ""), ("x " * 200, "fr"), (" ".join(map(str, range(300))), "fr"), ("", "de"), (None, "de"), ("\x0b", "de"), ("ÀÉ", "xx")] * 3)]
    odd += [(None, "a|b", "fr", None), (2001, "a|b", "fr", None), (2001, "a|b", "fr", None)]
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).withColumn("mask", F.lit("x")).withColumn("first", F.lit(1))
    labels = spark.createDataFrame([(k, k % 3 and 1, int(k % 5 == 0)) for k in range(0, 2020, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return both, labels


def test_against_each_order(spark, tables):
    both, labels = tables
    known = {}
    for d, q, t in labels.collect():
        old = known.get(d, (0, 0))
        known[d] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    known.pop(None)
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.audit(both, labels).collect()}
    assert found == plain([(r["doc_id"], r["lang"], r["text"]) for r in both.collect()], known)


def test_against_sql(spark, tables):
    both, labels = tables
    assert agrees(filter_audit.audit(both, labels), "op13_filter_audit", documents=both, labels=labels)


def test_removal_steps():
    orders, steps = filter_audit.removal_steps(4)
    for m in range(16):
        for o, order in enumerate(orders):
            assert steps[m, o] == next((k for k, f in enumerate(order) if m >> f & 1), 4)


def test_shares_add_up():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 32)
    orders, found = filter_audit.audit_of_counts(counts, counts // 2, counts * 0)
    assert (found["removed"].sum(axis=1) == counts[1:].sum()).all() and (found["kept"][:, -1] == counts[0]).all() and not found["toxic_lost"].any()
    assert (found["shapley"].sum(axis=1) == len(orders) * counts[1:].sum()).all()


def test_empty(spark, tables):
    both, labels = tables
    assert filter_audit.audit(edge.empty(spark, both), labels).count() == 0
    none = filter_audit.audit(both, edge.empty(spark, labels))
    assert none.agg(F.sum("good_lost")).first()[0] == 0


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    t = {n: queries.table(spark, sf, n) for n in ("documents", "labels")}
    assert agrees(queries.op13_filter_audit(spark, sf), "op13_filter_audit", **t)
