"""From a manifest to written results in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.operators import diff, layout, positions, sinks
from lockstep.plans import groups
from lockstep.sources import fasta, manifest


def compare_files(spark: SparkSession, manifest_path: str, phase: str = "SC", out: str | None = None, max_s: int | None = 1, wide: bool = False) -> DataFrame:
    """Checks the manifest, reads its sequences and compares each with chunks of ``max_s`` later ones (1: all pairs; None: all later ones).

    ``None`` and ``SC`` return ``first_index, chunk, Index, first_letter, letters``, lazy or sorted. ``MW`` writes lines under a header, one part in one
    folder a group below ``out`` (the name tells the group). ``DW`` writes CSV parts ``Index, first_letter, letters`` with a header, in as many parts a group as there
    are tasks that hold some of it, and adds to what is there. Both write all groups in one job and return what was written, with ``group_name``.

    ``wide`` gives the letters a column each (:func:`lockstep.operators.layout.wide_groups`; ``max_s`` must be given): returned by ``None`` and ``SC``, written as CSV with a header
    by ``DW`` and ``MW``, where ``MW`` makes one part a group."""
    if phase not in sinks.PHASES:
        raise ValueError(f"phase must be one of {sinks.PHASES}")
    if wide and max_s is None:
        raise ValueError("wide needs max_s, the number of its columns")
    lines = manifest.read_manifest_lines(spark, manifest_path)
    manifest.check_manifest(lines)
    sequences = fasta.read_sequences(spark, manifest.parse_manifest(lines))
    found = diff.one_vs_many(sequences, max_s)
    if wide:
        found = layout.wide_groups(found, max_s)
    if phase in ("None", "SC"):
        return layout.in_order(found, ("first_index", "chunk")) if phase == "SC" else found
    if not out:
        raise ValueError("a path is needed")
    plan = groups.chunk_plan(manifest.sequence_count(sequences), max_s)
    if wide:
        named = found.join(layout.named_groups(plan), ["first_index", "chunk"]).drop("first_index", "chunk")
        sinks.write_distributed(named.repartition("group_name") if phase == "MW" else named, out, by="group_name")
        return sinks.read_csv(spark, out, named.schema)
    if phase == "DW":
        named = sinks.flat(found).join(layout.named_groups(plan), ["first_index", "chunk"]).select("group_name", "Index", "first_letter", "letters")
        sinks.write_distributed(named, out, by="group_name")
        return sinks.read_csv(spark, out, "Index long, first_letter string, letters string, group_name string")
    members = positions.label_members(positions.members_of(groups.exploded(plan), sequences))
    sinks.write_lines(layout.as_lines(found), out, layout.header_lines(members, plan))
    return spark.read.option("lineSep", "\n").text(out).select(F.col("group_name").cast("string"), F.col("value").alias("line"))
