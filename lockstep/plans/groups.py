"""What is compared with what: all pairs, or each sequence with chunks of the later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _firsts(counted: DataFrame) -> tuple[DataFrame, int]:
    """``first_index`` of all but the last of ``n_sequences`` (of a one-row table), spread over tasks; and that number."""
    n = int(counted.first()["n_sequences"])
    return counted.sparkSession.range(max(0, n - 1)).withColumnRenamed("id", "first_index"), n


def pair_plan(counted: DataFrame) -> DataFrame:
    """``first_index, second_index`` for all ``i < j`` below ``n_sequences`` of a one-row table. No join is needed."""
    firsts, n = _firsts(counted)
    return firsts.select("first_index", F.explode(F.sequence(F.col("first_index") + 1, F.lit(n - 1).cast("long"))).alias("second_index"))


def chunk_plan(counted: DataFrame, max_s: int | None = None) -> DataFrame:
    """``first_index, chunk, second_indices``: the later indices in chunks of ``max_s`` (None: all in one), the last may be short."""
    if max_s is not None and max_s < 1:
        raise ValueError("max_s must be at least 1")
    firsts, n = _firsts(counted)
    step = max(1, n - 1) if max_s is None else max_s
    chunks = firsts.select("first_index", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 2 - F.col("first_index")) / step))).alias("chunk"))
    low = F.col("first_index") + 1 + F.col("chunk") * step
    return chunks.select("first_index", "chunk", F.sequence(low, F.least(low + step - 1, F.lit(n - 1).cast("long"))).alias("second_indices"))


def exploded(plan: DataFrame) -> DataFrame:
    """``first_index, chunk, second_index, ordinal`` of a chunk plan."""
    return plan.select("first_index", "chunk", F.posexplode("second_indices").alias("ordinal", "second_index")).select("first_index", "chunk", "second_index", F.col("ordinal").cast("long").alias("ordinal"))


def estimated_groups(n: Column, max_s: Column) -> Column:
    """The closed-form estimate; exact for pairs, 0 where max_s reaches n."""
    many = F.ceil(n * (n - 1) / max_s - n * (n - max_s) / (2 * max_s))
    return F.when(max_s == 1, F.floor(n * (n - 1) / 2)).when(max_s < n / 2, many).when(max_s < n, 2 * (n - 1) - max_s).otherwise(F.lit(0)).cast("long")


def plan_statistics(counted: DataFrame, sizes: list[int]) -> DataFrame:
    """For each chunk size: estimated and actual groups, and the error; null percent where the estimate is 0."""
    n = F.col("n_sequences").cast("long")
    sized = counted.select(n.alias("n_sequences"), F.explode(F.array(*(F.lit(s).cast("long") for s in sizes))).alias("max_s"))
    whole, rest = F.floor((F.col("n_sequences") - 1) / F.col("max_s")), (F.col("n_sequences") - 1) % F.col("max_s")
    actual = F.when(F.col("n_sequences") > 1, F.floor(F.col("max_s") * whole * (whole + 1) / 2) + rest * (whole + 1)).otherwise(0).cast("long")
    both = sized.withColumn("estimated", estimated_groups(F.col("n_sequences"), F.col("max_s"))).withColumn("actual", actual)
    error = F.abs(F.col("estimated") - F.col("actual"))
    return both.withColumns({"absolute_error": error, "percent_error": F.try_divide(error * 100.0, F.col("estimated").cast("double"))})
