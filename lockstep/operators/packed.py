"""Blocks of letters packed into bits, so that sequences are compared 64 letters at a time by plain columns.

The letters that occur are numbered; a number's bits are planes, and a plane of a block of 64 letters is one long. One more long tells
which of the 64 letters are there. Two blocks differ where any plane does and both letters are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.text import letters

WORD = 64


def blocks(sequences: DataFrame, key: str = "seq_index", size: int = 256) -> DataFrame:
    """``key, block, part``: each sequence cut once into blocks of ``size`` letters; an empty one has none. What is cut already stays."""
    if "block" in sequences.columns:
        return sequences.select(key, "block", "part")
    return sequences.select(key, F.posexplode(F.regexp_extract_all("seq", F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))).alias("block", "part"))


def alphabet(cut: DataFrame) -> list[str]:
    """The letters that occur in ``part``, in order: as many as a writing system has, and at most as many as Unicode has."""
    return sorted(r["x"] for r in cut.select(F.explode(F.array_distinct(letters(F.col("part")))).alias("x")).distinct().collect())


def _long(bits: Column) -> Column:
    """A text of ``WORD`` digits 0 and 1 as a long, the first digit its highest bit."""
    return F.conv(bits, 2, -10).cast("long")


def planes(cut: DataFrame, used: list[str], key: str = "seq_index") -> DataFrame:
    """``key, block, there, p0, p1, ...`` of blocks of ``WORD`` letters: the presence mask and the planes of the letters' numbers."""
    filled = lambda ones: F.rpad(F.translate("part", "".join(used), "".join(ones)), WORD, "0")
    number = range(max(1, (len(used) - 1).bit_length()))
    each = [_long(filled("01"[i >> k & 1] for i in range(len(used)))).alias(f"p{k}") for k in number]
    there = _long(F.rpad(F.repeat(F.lit("1"), F.length("part")), WORD, "0")).alias("there")
    return cut.select(key, "block", there, *each)


def plane_names(packed: DataFrame) -> list[str]:
    return [c for c in packed.columns if c[0] == "p" and c[1:].isdigit()]


def differing(names: list[str], a: str = "a", b: str = "b") -> Column:
    """The mask of letters in which the blocks ``a`` and ``b`` differ."""
    apart = reduce(lambda x, y: x.bitwiseOR(y), (F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}")) for n in names))
    return apart.bitwiseAND(F.col(f"{a}.there")).bitwiseAND(F.col(f"{b}.there"))


def varying_masks(packed: DataFrame) -> DataFrame:
    """``block, mask``: in which letters of a block not all sequences agree that have one there; blocks without such are left out.
    The planes are combined before the shuffle, which carries a row a block and task."""
    names = plane_names(packed)
    there = F.col("there")
    found = packed.groupBy("block").agg(*(x for n in names for x in (F.bit_or(F.col(n).bitwiseAND(there)).alias(f"{n}_one"), F.bit_or(F.bitwise_not(F.col(n)).bitwiseAND(there)).alias(f"{n}_none"))))
    mask = reduce(lambda x, y: x.bitwiseOR(y), (F.col(f"{n}_one").bitwiseAND(F.col(f"{n}_none")) for n in names))
    return found.select("block", mask.alias("mask")).filter("mask <> 0")


def places(mask: Column) -> Column:
    """The letters of a block that a mask names, from 0, in order."""
    bits = F.lpad(F.bin(mask), WORD, "0")
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.substring(bits, k + 1, F.lit(1)) == "1")
