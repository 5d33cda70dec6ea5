"""Connected components of a link table by alternating stars.

A step needs each node's least neighbour. It is found by an aggregation that combines before its shuffle, and is written before it is joined:
then both sides of the join are plain shuffles, which Spark may split where a node has very many links (the centre of a large star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.sources.shared import dropped, written


def _directed(df: DataFrame) -> DataFrame:
    """Distinct links from the larger end to the smaller."""
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _least(links: DataFrame) -> DataFrame:
    """``n, least``: the least neighbour of every node that has a smaller one."""
    return written(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least")), "least")


def _large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours on the least node it knows (itself, if none is smaller)."""
    return _directed(links.join(least, links["b"] == least["n"], "left").select("a", F.coalesce("least", "b").alias("b")))


def _small_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the least of them."""
    moved = links.join(least, links["a"] == least["n"]).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _directed(moved.unionByName(least.select(F.col("n").alias("a"), F.col("least").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """``a, b``: every linked node but the least of its component, and that least node. Steps until nothing changes; each
    step's links are written to the shared folder, and what no later step reads is removed."""
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    links = written(_directed(links), "links")
    seen = state(links)
    while seen[0]:
        old = [links]
        for star in (_large_star, _small_star):
            old.append(_least(links))
            links = written(star(links, old[-1]), "links")
            old.append(links)
        dropped(*old[:-1])
        now = state(links)
        if now == seen:
            break
        seen = now
    return links
