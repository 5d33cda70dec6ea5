"""A shared folder that is named without its file system, as in ``spark.checkpoint.dir /tmp/checkpoints``: local where ``fs.defaultFS`` is."""

import os

import pytest

from lockstep import queries
from lockstep.sources import shared

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plainly_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_SETTING", "spark.lockstep.test.shared")
    spark.conf.set("spark.lockstep.test.shared", f"{tmp_path}/a b%25/")
    yield tmp_path / "a b%25"
    spark.conf.unset("spark.lockstep.test.shared")


def folders_of_files(shared_folder):
    """The folders in which the documents' files lie."""
    return [d for d, _, names in os.walk(shared_folder) if "/fasta-" in d and any(not n.startswith((".", "_")) for n in names)]


def test_blocks_of_files_that_tasks_wrote(spark, plainly_named):
    assert shared.shared_dir(spark) == f"file:{plainly_named}"
    docs = queries.table(spark, SF, "documents").count()
    whole = {r["seq_index"]: r["seq"] for r in queries.fasta_files(spark, SF).collect()}
    parts = {(r["seq_index"], r["block"]): r["part"] for r in queries.fasta_blocks(spark, SF).collect()}
    assert len(whole) == docs and parts == {(k, b): s[256 * b : 256 * b + 256] for k, s in whole.items() for b in range(-(-len(s) // 256))}
    assert 0 < len(folders_of_files(plainly_named)) < docs  # Spark's writer makes a folder a document


def test_missing_files_among_those_that_tasks_wrote(spark, plainly_named):
    docs = [r["doc_id"] for r in queries.table(spark, SF, "documents").select("doc_id").collect()]
    found = sorted(map(tuple, queries.manifest_files(spark, SF).collect()))
    assert found == sorted((k, "file not found") for k in docs if k % 10 == 0)
    assert 0 < len(folders_of_files(plainly_named)) < len(docs)
