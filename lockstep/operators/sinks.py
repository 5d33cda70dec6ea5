"""Where a result goes: shown, written in parts, written merged in order, or nowhere yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from lockstep.sources.shared import dropped, written

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "nullValue": "\\N"}
PHASES = ("None", "SC", "DW", "MW")
FILE_ROWS = 10_000_000


def flat(groups: DataFrame) -> DataFrame:
    """A one-vs-many result with its letters joined by commas (missing ones as empty fields), which CSV can hold."""
    return groups.withColumn("letters", F.array_join("letters", ",", ""))


def write_distributed(df: DataFrame, path: str, mode: str = "append", by: str | None = None) -> None:
    """CSV parts with header, each sorted by position; ``by`` gives each group a folder, all in one job."""
    sorted_parts = df.sortWithinPartitions(*([by] if by else []), F.col("Index").asc_nulls_last())
    writer = sorted_parts.write.mode(mode).options(**_CSV)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_bucketed(df: DataFrame, path: str, by: str = "group_name", files: int = 200) -> None:
    """All groups in at most ``files`` CSV files: groups are dealt to files by hash and lie there one after the other, each sorted by position.

    Below ``path``, ``rows`` holds the files and ``index`` (Parquet) a row for each group: ``group, file, first_row, rows``. Fails if the path exists."""
    spark = df.sparkSession
    dealt = df.repartition(files, by).sortWithinPartitions(by, F.col("Index").asc_nulls_last())
    dealt.write.mode("errorifexists").options(**_CSV).csv(f"{path}/rows")
    names = spark.read.schema(df.schema).options(**_CSV, multiLine=True).csv(f"{path}/rows").select(F.col(by).alias("group"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    counted = names.groupBy("group", "file").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("group")) - F.col("rows")
    counted.select("group", "file", before.alias("first_row"), "rows").sort("group").write.mode("errorifexists").parquet(f"{path}/index")


def read_bucketed(spark: SparkSession, path: str, schema: StructType | str, group: str | None = None, by: str = "group_name") -> DataFrame:
    """What :func:`write_bucketed` wrote: all of it, or one group, of which only its file is read."""
    if group is None:
        return read_csv(spark, f"{path}/rows", schema)
    files = [r["file"] for r in spark.read.parquet(f"{path}/index").filter(F.col("group") == group).select("file").distinct().collect()]  # one
    rows = read_csv(spark, [f"{path}/rows/{f}" for f in files] or f"{path}/rows", schema)
    return rows.filter(F.col(by) == group)


def write_merged(df: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS) -> None:
    """The whole result in order of position, then of its other columns: one CSV file, or, where it has more than ``file_rows`` rows, as many as hold about
    that many each. Files follow each other by name, so read one after the other they are the one sorted file, and no task writes more than a file.

    Rows are written to the shared folder first, counted, and dealt to files by ranges of all sort columns, so a position with many rows is divided too."""
    whole = written(df, "merged")
    rows = whole.count()
    order = [F.col("Index").asc_nulls_last(), *(F.col(f"`{f.name}`") for f in whole.schema if f.name != "Index" and not isinstance(f.dataType, ArrayType | MapType | StructType | VariantType))]
    files = max(1, -(-rows // file_rows))
    dealt = whole.repartition(1) if files == 1 else whole.repartitionByRange(files, *order)
    dealt.sortWithinPartitions(*order).write.mode(mode).options(**_CSV).csv(path)
    dropped(whole)


def write_lines(lines: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    """Text parts of the column ``line``, sorted by position; fails if the path exists. With ``headers`` (``first_index, chunk,
    group_name, line``) each group has a folder of one part, which begins with the header; a group without rows has it too.
    A group has no more lines than its first sequence has letters."""
    if headers is None:
        lines.sortWithinPartitions("Index").select("line").write.mode("errorifexists").text(path)
        return
    heads = headers.select("group_name", F.lit(None).cast("long").alias("Index"), "line")
    named = lines.join(headers.select("first_index", "chunk", "group_name"), ["first_index", "chunk"]).select("group_name", "Index", "line")
    parts = heads.unionByName(named).repartition("group_name").sortWithinPartitions("group_name", F.col("Index").asc_nulls_first())
    parts.select("line", "group_name").write.mode("errorifexists").partitionBy("group_name").text(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """What the two writers wrote; letters may be line ends, quotes or blanks."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)


def collect_phase(df: DataFrame, phase: str, path: str | None = None) -> DataFrame:
    """Applies a collection phase and returns the result: lazy (None), sorted (SC), or written (DW, MW)."""
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {PHASES}")
    if phase == "SC":
        return df.orderBy(F.col("Index").asc_nulls_last())
    if phase in ("DW", "MW"):
        if not path:
            raise ValueError("a path is needed")
        (write_distributed if phase == "DW" else write_merged)(df, path)
    return df
