"""The position table: one row a letter, ``seq_index, Index, letter``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.text import label, letters


def explode_positions(sequences: DataFrame) -> DataFrame:
    """Positions are 0-based within the (cut) sequence; an empty sequence has none."""
    return sequences.select("seq_index", F.posexplode(letters(F.col("seq"))).alias("Index", "letter")).withColumn("Index", F.col("Index").cast("long"))


def longest_sequence(members: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, longest`` of sequences with their group's keys."""
    return members.groupBy(*keys).agg(F.max(F.length("seq")).cast("long").alias("longest"))


def members_of(plan: DataFrame, sequences: DataFrame) -> DataFrame:
    """Both sides of each group of an exploded chunk plan: ``first_index, chunk, side, ordinal, seq_index, seq_id, seq``."""
    first = plan.select("first_index", "chunk", F.lit(0).alias("side"), F.lit(0).cast("long").alias("ordinal"), F.col("first_index").alias("seq_index")).distinct()
    second = plan.select("first_index", "chunk", F.lit(1).alias("side"), "ordinal", F.col("second_index").alias("seq_index"))
    return union_sides(first, second).join(sequences, "seq_index")


def union_sides(first: DataFrame, second: DataFrame) -> DataFrame:
    """The two sides, each row tagged by ``side``, one below the other."""
    return first.unionByName(second)


def member_positions(members: DataFrame) -> DataFrame:
    """The letters of each group member, without padding."""
    return members.select(*(c for c in members.columns if c != "seq"), F.posexplode(letters(F.col("seq"))).alias("Index", "letter")).withColumn("Index", F.col("Index").cast("long"))


def pad_positions(members: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of each group member up to the group's longest sequence; beyond its own end a letter is null.

    Only the missing tail is made up, so no row carries a whole sequence's letters."""
    sized = members.withColumn("_n", F.length("seq").cast("long")).join(longest_sequence(members, keys), keys).filter("_n < longest")
    tail = sized.withColumn("Index", F.explode(F.sequence(F.col("_n"), F.col("longest") - 1))).withColumn("letter", F.lit(None).cast("string"))
    return member_positions(members).unionByName(tail.drop("_n", "longest", "seq"))


def label_members(members: DataFrame) -> DataFrame:
    """Members with ``label``; headerless ones are numbered in order inside their group's side."""
    return members.withColumn("label", label(F.col("seq_id"), F.col("ordinal") + 1))
