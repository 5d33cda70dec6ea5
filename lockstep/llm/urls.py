"""Operator 8, URL filters: a blocked Bloom filter before an exact hash join, all in DataFrame functions.

A rule is a canonical URL beginning: a host (it and all its subdomains) and the beginning of a path. A URL's candidates are its host's
suffixes of as many labels as some listed host has, each with its path's beginnings of the lengths that the list holds; so a URL costs what
the list's numbers of labels and lengths allow, however long it is. The filter has one 64-bit word a
block; a key's hash names the block and three bits in it. Candidates whose bits are all set are possible hits and go to the exact join on the
rule itself, which removes the false ones. Of a URL's rules the longest wins (ties: the larger text), and a URL without any is allowed.

The filter's size follows the number of rules up to ``MOST_BLOCKS`` words (8 MB), so its broadcast is bounded; the rules are broadcast
up to ``BROADCAST_RULES`` and shuffled beyond. Distinct URLs are judged once, so a hot URL costs one row before the last join.

Defined results: a null URL or one without ``://`` has empty host and path and meets no rule; hosts keep port and user as written;
repeated rows are judged alike; other columns are kept; an empty table gives no rows; an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.rows import quoted

MOST_BLOCKS, BROADCAST_RULES = 1 << 20, 100_000


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    """Three bits of a 64-bit word, from a second hash of the key."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, by), F.lit(64)).cast("int"))
    return bit(0).bitwiseOR(bit(20)).bitwiseOR(bit(40))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, word`` of a blocked Bloom filter over a column; at most ``blocks`` rows."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("word"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """All columns of ``pages`` (``url`` among them) with host, path, rule and verdict. ``rules``: verdict, host, path."""
    rules = rules.select("verdict", F.concat("host", "path").alias("listed"), F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels")).dropDuplicates(["listed"])
    count, lengths, depths = rules.agg(F.count("*"), F.collect_set("n"), F.collect_set("labels")).first()
    blocks = min(MOST_BLOCKS, max(1, 1 << (count // 4).bit_length()))  # 16 bits or more for a rule, as long as the bound allows
    whole = F.struct(*(F.col(quoted(c)) for c in pages.columns))  # one struct, so that no column can clash
    out = pages.select(whole.alias("row"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"))
    urls = out.select("_url").distinct().withColumn("host", url_host(F.col("_url"))).withColumn("path", url_path(F.col("_url")))
    labels = F.split("host", r"\.")
    fitting = F.filter(F.array(*map(F.lit, sorted(depths))).cast("array<int>"), lambda k: k <= F.size("labels"))
    suffixes = F.transform(fitting, lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = urls.filter("host <> ''").withColumn("labels", labels).withColumns({"suffixes": suffixes, "starts": starts}).select("_url", F.explode("suffixes").alias("suffix"), "starts").select("_url", F.explode(F.transform("starts", lambda p: F.concat("suffix", p))).alias("key"))
    words = F.broadcast(bloom_filter(rules, "listed", blocks))
    possible = candidates.join(words, _block(F.col("key"), blocks) == words["block"]).filter(F.col("word").bitwiseAND(_bits(F.col("key"))) == _bits(F.col("key")))
    exact = F.broadcast(rules) if count <= BROADCAST_RULES else rules
    hits = possible.join(exact, F.col("key") == exact["listed"]).groupBy("_url").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    hits = hits.select(F.col("_url").alias("_hit"), "best.rule", "best.verdict")
    judged = out.join(hits, F.col("_url") == F.col("_hit"), "left")
    own = (F.col(f"row.{quoted(c)}").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict"))
    return judged.select(*own, url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
