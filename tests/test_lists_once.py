"""What long lists of local files cost: one question a path, and no shuffle of texts that lie evenly."""

import os

import pytest
from pyspark.sql import functions as F

from lockstep.sources import files


@pytest.fixture
def stored(monkeypatch):
    """The plans of the tables that ``files`` stores."""
    plans, real = [], files.written
    monkeypatch.setattr(files, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    return plans


def test_local_paths_are_asked_once(spark, tmp_path, monkeypatch, stored):
    names = ["1", "_2", ".3", "4 é", "empty", "6\n7"]
    for k, n in enumerate(names):
        (tmp_path / n).write_text("" if n == "empty" else "x" * k + "y")
    odd = [f"{tmp_path}/./1", f"file://{tmp_path}//1", f"file:{tmp_path}/../{tmp_path.name}/1"]
    gone = [f"file:{tmp_path}/{k}.gone" for k in range(20)] + ["", f"file:{tmp_path}", f"{tmp_path}/nul\x00"]
    paths = [f"{tmp_path}/{n}" for n in names] + odd + gone
    listed = spark.createDataFrame([(p,) for p in [*paths, *paths, None]], "path string")
    monkeypatch.setattr(files, "LISTED", 2)
    found = sorted(map(tuple, files.existing_files(spark, listed).select("path", "length").collect()))
    assert found == sorted((p, os.path.getsize(p.removeprefix("file:"))) for p in paths[: len(names) + len(odd)])
    assert len(stored) == 1 and stored[0].count("MapInArrow") == 1 and stored[0].count("Exchange") == 1


@pytest.mark.parametrize("uneven", [False, True])
def test_texts_that_lie_evenly_are_written_where_they_lie(spark, tmp_path, stored, uneven):
    texts = spark.range(0, 400, numPartitions=4).select(F.col("id").alias("seq_index"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    texts = texts.coalesce(1) if uneven else texts
    made = files.write_texts(texts, f"file:{tmp_path}/f").collect()
    assert {r["seq_index"]: open(r["path"].removeprefix("file:"), encoding="utf-8").read() for r in made} == {k: f"é{k}" for k in range(400)}
    assert len({r["path"] for r in made}) == 400 and len(stored) == 1 and ("Exchange" in stored[0]) is uneven
