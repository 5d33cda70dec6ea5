"""Which of a list of paths are files, by the file systems that Spark reads.

Up to ``LISTED`` paths are asked one by one. Longer lists never pass through the driver: local files (which all executors must see at the same place, as for
all of Spark's readers) are looked up where the list lies, a question a path in tasks. On other file systems the folders that hold the paths (at most
``FOLDERS``; where they are more, folders above them) are listed by Spark without reading contents, and the list is joined with what they hold.
Paths that this does not show, such as missing, empty or hidden files, are asked for after that one by one."""

from __future__ import annotations

import errno
import os
import re
import stat
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.sources.shared import written

LISTED, FOLDERS = 1000, 1000
SMALL, HELD = 16 << 20, 8 << 20  # bytes of a file that a task reads whole; of texts that a task hands on at once
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"


def uri_form(path: Column) -> Column:
    """A URI as all readers are made to give it: local ones with one slash."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def escaped(path: str) -> str:
    """A path as Spark's readers take it, which read some characters as patterns else."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _one_by_one(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Each path costs one question of the driver to its file system."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for row in paths.select("path").distinct().toLocalIterator():
        try:
            path = jvm.org.apache.hadoop.fs.Path(row["path"])
            system = path.getFileSystem(conf)
            if not system.exists(path):  # an exception that comes over costs a hundred times this answer
                continue
            status = system.getFileStatus(path)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() not in ("FileNotFoundException", "IllegalArgumentException"):
                raise
            continue
        if status.isFile():
            found.append((row["path"], status.getPath().toUri().toString(), status.getLen()))
    return spark.createDataFrame(found, "path string, uri string, length long")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that stand for much work each (a file, pairs), dealt out to ``spark.sql.shuffle.partitions`` tasks however few bytes they have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _uri(full: str) -> str:
    """A local full path as the URI that Spark gives for it: what a URI cannot hold is quoted."""
    return re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]', lambda x: quote(x[0], safe=""), full)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, full, uri, length``: the last two only for the local full paths ``full`` that are files."""
    for batch in batches:
        uris, lengths = [], []
        for full in batch["full"].to_pylist():
            uri = length = None
            if full.startswith("file:"):
                try:
                    status = os.stat(full.removeprefix("file:"))
                    if stat.S_ISREG(status.st_mode):
                        uri, length = _uri(full), status.st_size
                except (OSError, ValueError) as error:
                    if isinstance(error, OSError) and error.errno not in (errno.ENOENT, errno.ENOTDIR, errno.EACCES, errno.ENAMETOOLONG, errno.ELOOP):
                        raise
            uris.append(uri)
            lengths.append(length)
        yield pa.RecordBatch.from_arrays([batch["path"], batch["full"], pa.array(uris, pa.string()), pa.array(lengths, pa.int64())], names=["path", "full", "uri", "length"])


def _in_tasks(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``path, full, uri, length`` of each path once; the last two only for local files, by a question a path. One shuffle finds repeats and gives all cores a share."""
    own = paths.select("path").filter("path is not null").repartition(2 * spark.sparkContext.defaultParallelism, "path").distinct()
    return own.withColumn("full", full_path(spark, F.col("path"))).mapInArrow(_looked_up, "path string, full string, uri string, length long")


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, content`` of local full paths ``path, full``; about ``HELD`` bytes are handed on at once."""
    shape = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        names, texts, size = [], [], 0
        for path, full in zip(batch["path"].to_pylist(), batch["full"].to_pylist(), strict=True):
            with open(full.removeprefix("file:"), "rb") as file:
                texts.append(file.read())
            names.append(path)
            size += len(texts[-1])
            if size >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], schema=shape)
                names, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], schema=shape)


def small_texts(spark: SparkSession, small: DataFrame) -> DataFrame:
    """``path, text`` of distinct local ``path`` to small files, read whole where the list lies: one row a file, whatever its name."""
    named = small.select("path").withColumn("full", full_path(spark, F.col("path")))
    return dealt(named, "path").mapInArrow(_read_whole, "path string, content binary").select("path", F.col("content").cast("string").alias("text"))


def is_small(spark: SparkSession) -> Column:
    """Of ``path, length``: what :func:`small_texts` takes. What Spark's readers unpack by its name is left to them."""
    return full_path(spark, F.col("path")).startswith("file:") & (F.col("length") <= SMALL) & ~F.col("path").rlike(r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$")


def _evenly(df: DataFrame) -> bool:
    """Whether no partition has over twice the rows that an even share of the cores has. Counting needs no column, so a table's contents are not read for it."""
    most, rows = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.sum("count")).first()
    return (most or 0) * df.sparkSession.sparkContext.defaultParallelism <= 2 * (rows or 0)


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """``seq_index, path``: a file for each ``seq_index, text``, all in the local ``folder`` (a ``file:`` path), a folder below it for each task.

    Tasks write the files themselves: Spark's own writer starts two processes for each local file to set its rights. A folder is used once,
    so a task that runs again leaves the files of the list as they are. Texts that lie evenly are written where they lie, others are dealt out first."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}/{uuid.uuid4().hex}"
        local = re.sub("^file:/+", "/", own)
        os.makedirs(local)
        count = 0
        for batch in batches:
            names = [f"{i}-{count + k}.fasta" for k, i in enumerate(batch["seq_index"].to_pylist())]
            count += len(names)
            for name, text in zip(names, batch["text"].cast(pa.binary()), strict=True):
                with open(f"{local}/{name}", "xb") as file:
                    file.write(text.as_buffer() or b"")
            yield pa.RecordBatch.from_arrays([batch["seq_index"], pa.array([f"{own}/{n}" for n in names], pa.string())], names=["seq_index", "path"])

    own_texts = texts.select("seq_index", "text")
    laid = own_texts if _evenly(own_texts) else own_texts.repartition("seq_index", "text")
    return written(laid.mapInArrow(write, "seq_index long, path string"), "listed")


def _asked(spark: SparkSession, rest: DataFrame) -> DataFrame:
    """``path, uri, length`` of those among ``path, full, uri, length`` that are files and that no listing shows: tasks have asked for the local ones; all others are asked for one by one."""
    local, far = rest.filter("length is not null").select("path", "uri", "length"), rest.filter(~F.col("full").startswith("file:"))
    return local if far.isEmpty() else local.unionByName(_one_by_one(spark, far))


def full_path(spark: SparkSession, path: Column) -> Column:
    """The path with its file system and from its root, without empty, ``.`` and ``..`` parts."""
    home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getWorkingDirectory()
    system = re.sub("^file:/+$", "file:", re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?)?", home.toString())[0])
    whole = F.when(path.rlike(_SCHEME), path).when(path.startswith("/"), F.concat(F.lit(system), path)).otherwise(F.concat(F.lit(home.toString() + "/"), path))
    local = whole.rlike("^file:")
    host = F.when(local, F.lit("file:")).otherwise(F.regexp_extract(whole, "^[^/]*//[^/]*|^[^/]*", 0))
    rest = F.when(local, F.regexp_replace(whole, "^file:(//[^/]*(?=/))?", "")).otherwise(F.substring(whole, F.length(host) + 1, F.length(whole)))
    parts = F.filter(F.split(rest, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))))
    plain = whole.startswith("file:/") & ~whole.rlike(r"/\.{0,2}(/|$)")  # most are, and cost no arrays
    return F.when(plain, whole).otherwise(F.concat(host, F.lit("/"), F.array_join(up, "/")))


def _above(path: Column) -> Column:
    """The folder of a full path; a root is its own."""
    cut = F.regexp_replace(path, "(?s)/[^/]*$", "")
    return F.when(cut.rlike("^[^/]*(//[^/]*)?$"), F.concat(cut, F.lit("/"))).otherwise(cut)


def folders_of(spark: SparkSession, paths: DataFrame, most: int | None = None) -> list[str]:
    """At most ``most`` folders that are there and under which all full paths (``full``) lie that exist, none within another (the roots of their file systems, if these alone are more)."""
    above, most = paths.select(_above(F.col("full")).alias("folder")).distinct(), most or FOLDERS
    depth = F.size(F.split("folder", "/"))
    deepest = above.agg(F.max(depth)).first()[0] or 0
    while above.limit(most + 1).count() > most and deepest > 2:
        above = above.select(F.when(depth == deepest, _above(F.col("folder"))).otherwise(F.col("folder")).alias("folder")).distinct()
        deepest -= 1
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for folder in sorted(r["folder"] for r in above.collect()):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(conf).exists(path) and not any(folder.startswith(o.rstrip("/") + "/") for o in out):
            out.append(folder)
    return out


def _hidden(path: Column) -> Column:
    """Names that Spark's readers pass over."""
    return F.substring_index(path, "/", -1).rlike("^[_.]")


def existing_files(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``path, uri, length`` of those in the column ``path`` that are files: relative, remote and oddly named ones too. A long list's result is stored, so
    that no file is asked for twice."""
    if paths.limit(LISTED + 1).count() <= LISTED:
        return _one_by_one(spark, paths)
    named = written(_in_tasks(spark, paths), "files")
    plain = (F.col("length") > 0) & ~_hidden(F.col("full"))
    found, rest = named.filter(plain).select("path", "uri", "length"), named.filter(~F.coalesce(plain, F.lit(False)))
    far = rest.filter(~F.col("full").startswith("file:"))
    if far.limit(LISTED + 1).count() > LISTED and (folders := folders_of(spark, far)):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([escaped(f) for f in folders])
        listed = listed.select(F.col("path").alias("there"), uri_form(F.col("_metadata.file_path")).alias("uri"), F.col("length"))
        shown = written(far.select("path", "full").join(listed, F.col("full") == F.col("there")).select("path", "uri", "length"), "files")
        found, rest = found.unionByName(shown), rest.join(shown, "path", "left_anti")
    return found.unionByName(_asked(spark, rest))
