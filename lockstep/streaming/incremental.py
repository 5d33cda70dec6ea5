"""Sequences that arrive in a folder, compared as they arrive: with a set at hand, or with all that is known by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.operators.diff import BLOCK, BROADCAST_BLOCKS, BROADCAST_ROWS, PAIR_COLUMNS, opened_pairs
from lockstep.operators.packed import blocks
from lockstep.operators.positions import explode_positions
from lockstep.sources.files import dealt

INDEX = "seq_index long, block int, part string, batch long"
AGAINST = ("new_index", "known_index", "Index", "new_letter", "known_letter")


def _joined(old: DataFrame, new: DataFrame, place: str, on: Column, most: int) -> DataFrame:
    """The rows ``a`` of ``old`` and ``b`` of ``new`` that are at one ``place`` and fit ``on``. The old ones are dealt out evenly, however few bytes they have, as their
    pairs are many: while the new ones are at most ``most`` they are sent to all; else each lot of the old ones meets a copy of the new ones."""
    on = (F.col(f"a.{place}") == F.col(f"b.{place}")) & on
    if not new.isStreaming and new.limit(most + 1).count() <= most:
        return old.alias("a").join(F.broadcast(new).alias("b"), on)
    lots = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = old.withColumn("lot", F.pmod(F.xxhash64("seq_index"), F.lit(lots)).cast("int"))
    right = new.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    return left.alias("a").join(right.alias("b"), on & (F.col("a.lot") == F.col("b.lot")))


def _met(old: DataFrame, new: DataFrame, on: Column) -> DataFrame:
    """``i, j, block, x, y``: unequal blocks at one place."""
    met = _joined(dealt(old, "seq_index", "block"), new, "block", on & (F.col("a.part") != F.col("b.part")), BROADCAST_BLOCKS)
    return met.select(F.col("a.seq_index").alias("i"), F.col("b.seq_index").alias("j"), "a.block", F.col("a.part").alias("x"), F.col("b.part").alias("y"))


def diff_against(arriving: DataFrame, at_hand: DataFrame) -> DataFrame:
    """``new_index, known_index, Index, new_letter, known_letter``. ``arriving`` may be a stream: the join is stateless."""
    new, known = explode_positions(arriving), explode_positions(dealt(at_hand, "seq_index"))
    met = _joined(known, new, "Index", F.col("a.letter") != F.col("b.letter"), BROADCAST_ROWS)
    return met.select(F.col("b.seq_index").alias("new_index"), F.col("a.seq_index").alias("known_index"), "a.Index", F.col("b.letter").alias("new_letter"), F.col("a.letter").alias("known_letter"))


def write_differences(stream: DataFrame, at_hand: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """:func:`diff_against` for what has arrived so far, batch by batch; a later call goes on from there. A batch writes its own folder below ``out`` in place of
    what is there, so a batch that is processed again writes nothing twice. Returns what was found so far."""
    spark = at_hand.sparkSession
    shape = ", ".join(f"{c} {t}" for c, t in zip(AGAINST, ("long", "long", "long", "string", "string"), strict=True))
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{out}/batch=-1")
    process = lambda arrived, batch: diff_against(arrived, at_hand).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*AGAINST)


def write_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what has arrived so far, appends it as Parquet and stops; a later call goes on from there."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def compare_arrivals(stream: DataFrame, known: DataFrame, index: str, out: str, checkpoint: str) -> DataFrame:
    """Compares each arriving sequence with the known ones, with all that arrived in earlier batches and with those of its own batch; processes what is
    there and stops, and a later call goes on. Returns what was found so far: ``PAIR_COLUMNS``, the smaller index first. Indices must not repeat.

    Below ``index`` the sequences are kept in blocks, one folder a batch (``batch=-1``: the known ones). A batch writes its blocks, and below ``out`` its
    differences, into folders of its number in place of what is there, so a batch that is processed again writes nothing twice. Only its own
    blocks are sent to the known ones, as long as they are few; the known ones are dealt out to all tasks."""
    spark = known.sparkSession
    blocks(known, size=BLOCK).write.mode("overwrite").parquet(f"{index}/batch=-1")

    def process(arrived: DataFrame, batch: int) -> None:
        blocks(arrived, size=BLOCK).write.mode("overwrite").parquet(f"{index}/batch={batch}")
        here = spark.read.schema(INDEX).parquet(index)
        new, old = here.filter(F.col("batch") == batch).drop("batch"), here.filter(F.col("batch") < batch).drop("batch")
        both = _met(old, new, F.lit(True)).unionByName(_met(new, new, F.col("a.seq_index") < F.col("b.seq_index")))
        opened_pairs(both, BLOCK).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in zip(PAIR_COLUMNS, ("long", "long", "long", "string", "string"), strict=True))).write.mode("overwrite").parquet(f"{out}/batch=-1")
    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(*PAIR_COLUMNS)
