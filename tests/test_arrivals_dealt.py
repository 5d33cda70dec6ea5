"""Arrivals against many short known sequences: their pairs are dealt out to all tasks, whatever place of a text they are at."""

import pytest
from pyspark.sql import functions as F

from lockstep.streaming import incremental

SHAPE = "seq_index long, seq_id string, seq string"


def arrivals(spark, tmp_path, texts):
    spark.createDataFrame([(k, "n", t) for k, t in enumerate(texts)], SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), [str(tmp_path / x) for x in ("index", "out", "progress")]


def many(spark, texts):
    return spark.createDataFrame([(-1 - k, "k", t) for k, t in enumerate(texts)], SHAPE).coalesce(1)


def unlike(a, b):
    return [(k, x, y) for k, (x, y) in enumerate(zip(a, b)) if x != y]


@pytest.mark.parametrize("most", [0, 1000])
def test_differences_of_one_place_are_made_in_many_tasks(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(incremental, "BROADCAST_ROWS", most)
    old, new = ["ACGT"[k % 4] for k in range(80)], ["A", "CG" * 300, ""]
    stream, (_, out, progress) = arrivals(spark, tmp_path, new)
    arrived = spark.read.schema(SHAPE).parquet(str(tmp_path / "in"))
    assert incremental.diff_against(arrived, many(spark, old)).select(F.spark_partition_id()).distinct().count() > 1
    want = sorted((j, -1 - i, k, x, y) for j, b in enumerate(new) for i, a in enumerate(old) for k, x, y in unlike(b, a))
    for _ in range(2):  # nothing new arrives before the second call
        assert sorted(map(tuple, incremental.write_differences(stream, many(spark, old), out, progress).collect())) == want


@pytest.mark.parametrize("most", [0, 1000])
def test_pairs_of_short_sequences_are_made_in_many_tasks(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(incremental, "BROADCAST_BLOCKS", most)
    real, tasks = incremental.opened_pairs, []
    monkeypatch.setattr(incremental, "opened_pairs", lambda met, size: tasks.append(met.filter("i < 0").select(F.spark_partition_id()).distinct().count()) or real(met, size))
    texts = {-1 - k: "ACé"[k % 3] * (k % 5) for k in range(60)} | dict(enumerate(["A", "CG" * 300, "", "Aé" * 200]))
    stream, paths = arrivals(spark, tmp_path, [texts[k] for k in range(4)])
    found = incremental.compare_arrivals(stream, many(spark, [texts[-1 - k] for k in range(60)]), *paths)
    assert sorted(map(tuple, found.collect())) == sorted((i, j, k, x, y) for i, a in texts.items() for j, b in texts.items() if i < j and j >= 0 for k, x, y in unlike(a, b)) and min(tasks) > 1
