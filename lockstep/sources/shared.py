"""The folder that the driver and all executors share.

Long jobs cut their lineage by writing a table there and reading it again, so that a lost executor costs one stage and not
the whole job. The folder is the one the cluster names in ``spark.checkpoint.dir``. Only in local mode, where driver and tasks
are one process, a temporary folder of our own takes its place if that is unset; elsewhere a missing setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_OURS = re.compile(r".+-[0-9a-f]{32}")
_scopes: list[list[str]] = []


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lockstep-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's path with its file system, without a slash at its end: a setting like ``/tmp/shared`` says only by ``fs.defaultFS`` where it lies."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        found = _local_dir()
    if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", found):
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: same rows, lineage cut."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    if not _OURS.fullmatch(folder.rpartition("/")[2]):
        raise ValueError(f"{folder} was not written here")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all tables that :func:`written` makes inside. Results are lazy and read them: store a result before the end.

    ``with scratch(spark): op.extract(pages).write.parquet(path)``"""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            _remove(spark, folder)


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by :func:`written`, when nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            _remove(spark, folder)
