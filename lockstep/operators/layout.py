"""Layouts of a result: wide, as text lines, sorted, named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.text import group_name, row_text

MOST_COLUMNS = 10_000


def wide(positions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``Index`` and one column for each ``label`` of ``seq_index, label, Index, letter``; a repeated label gets its sequence index.

    Without ``labels`` they are looked up; more than ``MOST_COLUMNS`` of them are an error, as no table has so many columns."""
    if labels is None:
        found = positions.select("seq_index", "label").distinct().orderBy("seq_index").limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} sequences: too many for columns")
        seen: set[str] = set()
        renamed = {}
        for r in found:
            renamed[r["seq_index"]] = f"{r['label']}_{r['seq_index']}" if r["label"] in seen else r["label"]
            seen.add(r["label"])
        labels = list(renamed.values())
        positions = positions.drop("label").join(F.broadcast(positions.sparkSession.createDataFrame(list(renamed.items()), "seq_index long, label string")), "seq_index")
    return positions.groupBy("Index").pivot("label", labels).agg(F.first("letter", ignorenulls=True))


def wide_rows(groups: DataFrame, first: str, seconds: list[str]) -> DataFrame:
    """``Index``, the first sequence's letter and one column for each second of a one-vs-many result of one group."""
    return groups.select("Index", F.col("first_letter").alias(first), *(F.get("letters", F.lit(k)).alias(name) for k, name in enumerate(seconds)))


def wide_groups(groups: DataFrame, max_s: int) -> DataFrame:
    """``first_index, chunk, Index, first, second_0, second_1, ...``: all groups of a one-vs-many result (chunks of ``max_s``) in one wide table, a column for each place of
    a chunk. A place that a shorter chunk lacks is null. ``max_s`` is the number of columns, so it must be given and at most ``MOST_COLUMNS``."""
    if not 1 <= max_s <= MOST_COLUMNS:
        raise ValueError(f"max_s must be from 1 to {MOST_COLUMNS}")
    return groups.select("first_index", "chunk", "Index", F.col("first_letter").alias("first"), *(F.get("letters", F.lit(k)).alias(f"second_{k}") for k in range(max_s)))


def wide_group(groups: DataFrame, members: DataFrame, first_index: int, chunk: int = 0) -> DataFrame:
    """One group of a one-vs-many result as a table of its own: ``Index`` and a column for each sequence, first the first one, named by its label.

    ``members`` are the labelled members of all groups (``first_index, chunk, side, ordinal, seq_index, label``); a label that repeats in the group, in any case of letters, or is ``Index``
    gets its sequence index, as in :func:`wide`. A group that ``members`` lacks is an error."""
    of = (F.col("first_index") == first_index) & (F.col("chunk") == chunk)
    found = members.filter(of).select("side", "ordinal", "seq_index", "label").orderBy("side", "ordinal").limit(MOST_COLUMNS + 1).collect()
    if not found or len(found) > MOST_COLUMNS:
        raise ValueError(f"group {first_index}, {chunk}: " + ("too many sequences for columns" if found else "not there"))
    seen, names = {"index"}, []
    for r in found:
        name = r["label"]
        while name.lower() in seen:
            name += f"_{r['seq_index']}"
        names.append(name)
        seen.add(name.lower())
    return wide_rows(groups.filter(of), names[0], names[1:])


def as_lines(groups: DataFrame) -> DataFrame:
    """``first_index, chunk, Index, line``."""
    return groups.select("first_index", "chunk", "Index", row_text(F.col("Index"), F.col("first_letter"), F.col("letters")).alias("line"))


def header_lines(labelled: DataFrame, plan: DataFrame) -> DataFrame:
    """``first_index, chunk, group_name, line``: the header of each group of a chunk plan, from its members' labels."""
    heads = labelled.groupBy("first_index", "chunk").agg(F.sort_array(F.collect_list(F.struct("side", "ordinal", "label"))).alias("of"))
    line = F.concat(F.lit("Index,"), F.array_join(F.transform("of", lambda x: x["label"]), ","))
    return heads.join(named_groups(plan), ["first_index", "chunk"]).select("first_index", "chunk", "group_name", line.alias("line"))


def in_order(df: DataFrame, keys: tuple[str, ...] = ("first_index", "second_index")) -> DataFrame:
    """Sorted by group, then by position, nulls last."""
    return df.orderBy(*keys, F.col("Index").asc_nulls_last())


def named_groups(plan: DataFrame) -> DataFrame:
    """``first_index, chunk, group_name`` of a chunk plan."""
    return plan.select("first_index", "chunk", group_name(F.col("first_index"), F.col("second_indices")).alias("group_name"))
