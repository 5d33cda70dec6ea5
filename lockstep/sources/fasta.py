"""FASTA files and string columns as sequences ``seq_index, seq_id, seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockstep.functions.text import bounds, fasta_body, fasta_id, interval, strip_right
from lockstep.operators.packed import blocks
from lockstep.sources.files import LISTED, escaped, existing_files, folders_of, full_path, is_small, small_texts, uri_form


def read_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``path, text``: one row a file that is not empty, below folders too; the path as a URI."""
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(uri_form(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def parse_fasta(texts: DataFrame) -> DataFrame:
    """``seq_index, seq_id, seq`` of ``seq_index, text``."""
    return texts.select("seq_index", fasta_id(F.col("text")).alias("seq_id"), fasta_body(F.col("text")).alias("seq"))


def slice_sequences(sequences: DataFrame) -> DataFrame:
    """Sequences cut to their ``start_pos, end_pos``."""
    return sequences.withColumn("seq", interval(F.col("seq"), F.col("start_pos"), F.col("end_pos"))).drop("start_pos", "end_pos")


def _listed(spark: SparkSession, manifest: DataFrame) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """The manifest's files (``path, uri, length``); where these are very many, the ``path`` of those that tasks read whole; and paths for Spark's readers: the other files that hold something, or the folders of very many."""
    files = existing_files(spark, manifest)
    missing = sorted(r["path"] for r in manifest.select("path").distinct().join(files, "path", "left_anti").limit(10).collect())
    if missing:
        raise FileNotFoundError(f"not found: {', '.join(missing)}")
    full = files.filter("length > 0").select("path", "uri", "length")
    small, few = None, [r["uri"] for r in full.select("uri").distinct().limit(LISTED + 1).collect()]
    if len(few) > LISTED:
        small, full = full.filter(is_small(spark)).select("path"), full.filter(~is_small(spark))
        few = [r["uri"] for r in full.select("uri").distinct().limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return files, small, [escaped(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(u)).toString()) for u in few]
    return files, small, [escaped(f) for f in folders_of(spark, full.select(full_path(spark, F.col("path")).alias("full")))]


def _cut(named: DataFrame) -> DataFrame:
    """Sequences of rows with ``seq_index, text, start_pos, end_pos``, cut."""
    return slice_sequences(named.select("seq_index", fasta_id(F.col("text")).alias("seq_id"), fasta_body(F.col("text")).alias("seq"), "start_pos", "end_pos"))


def read_sequences(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The sequences of a parsed manifest. Lists of over ``LISTED`` paths do not pass through the driver: tasks read their small local files, and where Spark's readers have more than that left, all files of those folders are read. A sequence is one row: for longer ones see :func:`read_blocks`.

    Relative paths start at the working folder of their file system, as everywhere in Spark. FileNotFoundError for a path that
    is no file; a file whose text then is not found ends the job with an error, so no sequence is ever left out.
    """
    files, small, plain = _listed(spark, manifest)
    texts = read_texts(spark, plain) if plain else spark.createDataFrame([], "path string, text string")
    rest = files if small is None else files.join(small, "path", "left_anti")
    named = manifest.join(rest, "path").join(texts.withColumnRenamed("path", "_path"), uri_form(F.col("uri")) == F.col("_path"), "left")
    text = F.when(F.col("length") == 0, "").when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text read for "), "path"))).otherwise(F.col("text"))
    found = _cut(named.withColumn("text", text))
    return found if small is None else found.unionByName(_cut(manifest.join(small_texts(spark, small), "path")))


def body_lines(spark: SparkSession, paths: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """``file, at, text, total``: each line after a file's first one, cut at the right, where it begins in the file's body and how long that is.

    Lines are read split by split and keep their split's place in the file. Lengths are summed inside splits, and the splits' sums, a
    row for each, across them: no file passes through one task, and no row is longer than a line. ``wanted``: the files (``of``) to keep."""
    lines = spark.read.text(paths, recursiveFileLookup=True).select(uri_form(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"), "value")
    if wanted is not None:
        lines = lines.join(wanted.select(F.col("of").alias("file")).distinct(), "file", "left_semi")
    order = Window.partitionBy("file", "split").orderBy("k")
    head = (F.col("split") == 0) & (F.row_number().over(order) == 1)
    lines = lines.withColumn("text", F.when(head, F.lit("")).otherwise(strip_right(F.col("value")))).drop("value")
    within = F.sum(F.length("text").cast("long")).over(order) - F.length("text")
    lines = lines.select("file", "split", "text", within.alias("within"))
    of_file = Window.partitionBy("of").orderBy("from")
    sums = lines.groupBy(F.col("file").alias("of"), F.col("split").alias("from")).agg(F.sum(F.length("text").cast("long")).alias("n"))
    sums = sums.select("of", "from", (F.sum("n").over(of_file) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("total"))
    met = lines.filter("text <> ''").join(sums, (F.col("file") == F.col("of")) & (F.col("split") == F.col("from")))
    return met.select("file", (F.col("before") + F.col("within")).alias("at"), "text", "total")


def read_blocks(spark: SparkSession, manifest: DataFrame, size: int = 256) -> DataFrame:
    """``seq_index, block, part``: the sequences of a parsed manifest in blocks of ``size`` letters, cut to their intervals, however long they are.

    Line ends are ``\\n``, ``\\r\\n`` and ``\\r``. A sequence without letters has no block. Errors are those of :func:`read_sequences`; a file that is one line is one row.
    The small files of a long list are rows of their own, cut into blocks where they are read."""
    files, small, plain = _listed(spark, manifest)
    none = spark.createDataFrame([], "seq_index long, block int, part string")
    whole = none if small is None else blocks(_cut(manifest.join(small_texts(spark, small), "path")), size=size)
    if not plain:
        return whole
    files = files if small is None else files.join(small, "path", "left_anti")
    named = manifest.join(files, "path").filter("length > 0").select("seq_index", "start_pos", "end_pos", uri_form(F.col("uri")).alias("of"))
    met = body_lines(spark, plain, named).join(named, F.col("file") == F.col("of"))
    first, stop = bounds(F.col("total"), F.col("start_pos"), F.col("end_pos"))
    met = met.select("seq_index", "at", "text", first.alias("first"), stop.alias("stop"))
    low, high = F.greatest("at", "first"), F.least(F.col("at") + F.length("text"), "stop")
    own = met.withColumns({"low": low, "high": high}).filter("low < high").select("seq_index", (F.col("low") - F.col("first")).alias("at"), F.expr("substring(text, int(low - at) + 1, int(high - low))").alias("text"))
    last = F.col("at") + F.length("text") - 1
    each = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(last / size))))
    begin = F.greatest(F.col("at"), F.col("block") * size)
    each = each.withColumns({"begin": begin, "upto": F.least(last + 1, (F.col("block") + 1) * size)}).select("seq_index", "block", "begin", F.expr("substring(text, int(begin - at) + 1, int(upto - begin))").alias("piece"))
    held = F.sort_array(F.collect_list(F.struct("begin", "piece")))
    joined = each.groupBy("seq_index", "block").agg(F.array_join(F.transform(held, lambda x: x["piece"]), "").alias("part"))
    return whole.unionByName(joined.select("seq_index", F.col("block").cast("int").alias("block"), "part"))


def sequences_from_table(df: DataFrame, index: str, text: str, prefix: str = "") -> DataFrame:
    """Any string column as sequences; a null text is an empty sequence."""
    return df.select(F.col(index).cast("long").alias("seq_index"), F.concat(F.lit(prefix), F.col(index).cast("string")).alias("seq_id"), F.coalesce(F.col(text), F.lit("")).alias("seq"))


def select_sequences(sequences: DataFrame, indices: DataFrame) -> DataFrame:
    """The sequences whose index stands in ``indices(seq_index)``."""
    return sequences.join(indices.select("seq_index").distinct(), "seq_index", "left_semi")
