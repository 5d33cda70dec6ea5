"""The manifest: an ordered text of lines ``path, [start,end]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions.text import strip, text_lines
from lockstep.sources.files import existing_files

_FIELDS = ", "


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """``seq_index, line`` of one manifest file; a line end at the end of the file starts no line."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace(F.array_join(text_lines(F.col("value")), "\n"), "\n$", ""), "\n")
    return whole.filter("value <> ''").select(F.posexplode(lines).alias("seq_index", "line")).select(F.col("seq_index").cast("long"), "line")


def parse_manifest(lines: DataFrame) -> DataFrame:
    """``seq_index, path, start_pos, end_pos`` of valid lines; the patterns are greedy, like ``[`` up to the last comma."""
    fields = F.split(strip(F.col("line")), _FIELDS)
    span = F.element_at(fields, 2)
    parsed = lines.filter(F.size(fields) == 2).select(
        "seq_index", F.element_at(fields, 1).alias("path"), F.regexp_extract(span, r"\[(.*),", 1).alias("start_pos"), F.regexp_extract(span, r",(.*)\]", 1).alias("end_pos")
    )
    return parsed


def manifest_violations(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``seq_index, violation``: lines without exactly two fields, paths not among ``files(path)``, and fewer than two lines (index null)."""
    wrong = lines.filter(F.size(F.split(strip(F.col("line")), _FIELDS)) != 2).select("seq_index", F.lit("bad field count").alias("violation"))
    missing = parse_manifest(lines).join(files.select("path"), "path", "left_anti").select("seq_index", F.lit("file not found").alias("violation"))
    few = lines.agg(F.count("*").alias("n")).filter("n < 2").select(F.lit(None).cast("long").alias("seq_index"), F.lit("fewer than 2 sequences").alias("violation"))
    return wrong.unionByName(missing).unionByName(few)


def check_manifest(lines: DataFrame, files: DataFrame | None = None) -> None:
    """Raises ValueError (FileNotFoundError for a missing file) for the first violation: line by line, field count before existence,
    the number of lines last. Without ``files`` the library looks the paths up itself."""
    files = existing_files(lines.sparkSession, parse_manifest(lines)) if files is None else files
    worst = manifest_violations(lines, files).orderBy(F.col("seq_index").asc_nulls_last(), "violation").first()
    if worst:
        where = "the manifest" if worst["seq_index"] is None else f"line {worst['seq_index']}"
        raise (FileNotFoundError if worst["violation"] == "file not found" else ValueError)(f"{where}: {worst['violation']}")


def sequence_count(sequences: DataFrame) -> DataFrame:
    """One row: how many sequences there are, repeated paths included."""
    return sequences.agg(F.count("*").alias("n_sequences"))
