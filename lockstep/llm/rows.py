"""Rows told apart by all they hold, for operators that judge a slim table and then act on the wide one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row, nulls apart from texts. It is joined together with doc_id, so only rows of one id could ever be confused."""
    return F.xxhash64(*(x for c in df.columns for x in (F.col(quoted(c)).isNull(), F.col(quoted(c)).cast("string"))))


def times(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Every distinct row of ``df`` as often as ``counts`` says (``_key, doc_id, _n``, one row for each kept key; ``_m``: how many rows are so).

    The whole row travels as one struct, so no column of ``df`` can clash. Rows that are there once need no comparison with others;
    only those that are there several times are brought together."""
    whole = df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), row_key(df).alias("k"), F.col("doc_id").cast("long").alias("id"))
    wanted = counts.select(F.col("_key").alias("k2"), F.col("doc_id").alias("id2"), F.col("_n").cast("int").alias("n"), F.col("_m").alias("m"))
    met = whole.join(wanted, (F.col("k") == F.col("k2")) & F.col("id").eqNullSafe(F.col("id2")))
    once = met.filter("m = 1").select("row", "n").unionByName(met.filter("m > 1").dropDuplicates(["k", "id"]).select("row", "n"))
    return once.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).select("row.*")
