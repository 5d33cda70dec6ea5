import re

import edge

from lockstep.llm import urls
from lockstep.llm.queries import QUERIES
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.b.c", ""), ("allow", "a.b.c", "/x")]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "") if "://" in (url or "") else None
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://www.example.org/es/1", "https://www.example.org/es", "http://notexample.org/es/1", "http://example.org/en/17?x=/es/", "http://m.x.com/fr/1#/de/",
    "http://x.com/de/a\nb", "ftp://COM/de/", "http://a.b.c", "http://z.a.b.c/xy", "http://a.b.c/y?z", "http://b.c/x", "http://ÀÉ.com/fr/", "http://u:p@x.com:80/de/", "x://y://z.org/", "http://x.net?http://x.org/", "http://" + "s." * 300 + "org/" + "p" * 5000, "http://.org/", "http://org./",
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)] + [(None, URLS[5], "x", "y")], "page_id long, url string, host string, key string").repartition(3)
    rules = spark.createDataFrame(RULES * 2, "verdict string, host string, path string")
    found = edge.plain(urls.judge(df, rules))
    assert len(found) == 2 * len(URLS) + 1 and {r["key"] for r in found} == {"y"}
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], RULES), r["url"]
    assert edge.plain(urls.judge(edge.empty(spark, df), rules)) == []
    assert {(r["rule"], r["verdict"]) for r in edge.plain(urls.judge(df, edge.empty(spark, rules)))} == {(None, "allow")}


def test_large_lists_by_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BLOCKS", 64)
    monkeypatch.setattr(urls, "BROADCAST_RULES", 10)
    listed = [("block", f"h{i}.net", f"/{i % 7}/") for i in range(3000)]
    df = spark.createDataFrame([(i, f"http://w.h{i}.net/{i % 5}/") for i in range(0, 6000, 3)], "page_id long, url string")
    for r in edge.plain(urls.judge(df, spark.createDataFrame(listed, "verdict string, host string, path string"))):
        i = r["page_id"]
        assert (r["verdict"] == "block") == (i < 3000 and i % 5 == i % 7)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    words = urls.bloom_filter(keys, "k", 2048)
    ask = spark.range(20_000).select("id", F.concat(F.lit("k"), "id").alias("k"))
    hit = ask.join(words, urls._block(F.col("k"), 2048) == words["block"]).filter(F.col("word").bitwiseAND(urls._bits(F.col("k"))) == urls._bits(F.col("k")))
    found = {r.id for r in hit.select("id").collect()}
    assert set(range(5000)) <= found and len(found) < 5000 + 1500


def test_hosts_of_very_many_labels(spark):
    host = "a." * 100_000 + "example.org"
    found_in = [(1, f"http://{host}/en/1x"), (2, "http://" + "." * 50_000 + "com/de/"), (3, "http://org/" + "p" * 100_000)]
    rules = spark.createDataFrame([("block", "example.org", "/en/1"), ("block", "com", "/de/"), ("allow", "org", "/")], "verdict string, host string, path string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in edge.plain(urls.judge(spark.createDataFrame(found_in, "page_id long, url string"), rules))}
    assert found == {1: ("example.org/en/1", "block"), 2: ("com/de/", "block"), 3: ("org/", "allow")}


def test_many_path_lengths(spark):
    rules = spark.createDataFrame([("block", "h.org", "/" + "x" * n) for n in range(1500)], "verdict string, host string, path string")
    pages = spark.createDataFrame([(n, "http://h.org/" + "x" * n) for n in (0, 7, 1499, 3000)], "page_id long, url string")
    assert {r["page_id"]: len(r["rule"]) for r in edge.plain(urls.judge(pages, rules))} == {n: 6 + min(n, 1499) for n in (0, 7, 1499, 3000)}


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op8_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))




def test_any_column_names(spark):
    df = spark.createDataFrame([(1, URLS[5], 7, 8, 9, 10, 11, 12)], "page_id long, url string, _hit int, _url int, row int, best int, `a.b` int, block int")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    (found,) = edge.plain(urls.judge(df, rules))
    assert found == {"page_id": 1, "url": URLS[5], "_hit": 7, "_url": 8, "row": 9, "best": 10, "a.b": 11, "block": 12, "host": "example.org", "path": "/", "rule": "org/", "verdict": "allow"}
