"""Operator 10, document fingerprints by order MinHash, in DataFrame functions alone.

A text's words (pieces of at most eight code points, so that texts without spaces have some too) give k-mers of two; equal ones are
told apart by their occurrence number. Each k-mer is hashed once, and a repeated one again with its number. The upper bits of the hash choose one of ``SLOTS`` parts,
and in each part the two smallest hashes are selected and put back into text order; the pair in that order is hashed to a 32-bit
sketch. The likeness of two texts is the share of agreeing parts among those that either fills: it falls with edits and with moved
passages, where that of a plain MinHash falls with edits only. All parts come from one hash a k-mer, not from one each.

Everything is done inside the row: hash and position are packed into one long, so sorting is of plain longs, and an occurrence
number is the distance from the start of a run of equal hashes, found by halving and for repeated k-mers only. The next document
comes from a window inside ranges of about ``RANGE_ROWS`` rows, however far apart the ids are: Spark's range partitioner gives the borders on doc_id and
hash of the text, at most ``MOST_RANGES``; a small table of the ranges' first texts links one range to the next. Texts are shuffled once. Rows that
repeat one doc_id and text more than ``RANGE_ROWS`` times are counted: one of them stands in its range, the others are followed by their like.

Defined results: null text is empty; a text of one word has one k-mer; without words the fingerprint is empty, and two such are
alike to 1; rows with a null doc_id come last; rows of equal doc_id are ordered by hash of the text, then by text; every repeated row is a row; other
columns are ignored; with one row the next document is itself; an empty table gives no rows. A text of over 2**26 words is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.sources.shared import dropped, written

SLOTS, WORD, POSITION_BITS, COPIES = 64, 8, 26, 65_536
RANGE_ROWS, MOST_RANGES, BROADCAST_REPEATS = 2000, 65_536, 100_000
_SLOT_SHIFT = 63 - (SLOTS.bit_length() - 1)


def _packed(hashed: Column, position: Column) -> Column:
    """A non-negative long: the upper bits of the hash, then the position."""
    return F.shiftleft(F.shiftrightunsigned(hashed, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(position.cast("long"))


def _hash(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long"))


def _slot(x: Column) -> Column:
    return F.shiftright(x, _SLOT_SHIFT)


def sketches(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with an array of longs for a text column: slot and sketch of each part that selects something."""
    a, b, c, d = (f"_{name}{k}" for k in range(4))
    item = lambda column, i: F.get(F.col(column), i)
    words = F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{WORD}}}"), F.lit(0))
    too_many = F.raise_error(F.lit(f"a text has over 2**{POSITION_BITS} words")).cast("array<bigint>")
    df = df.withColumn(a, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(a, F.when(F.size(a) > 1 << POSITION_BITS, too_many).otherwise(F.col(a)))
    df = df.withColumn(b, F.sort_array(F.transform(a, lambda w, i: _packed(F.xxhash64(w, item(a, i + 1)), i))))
    halves = F.filter(F.array(*(F.lit(1 << k) for k in reversed(range(POSITION_BITS)))), lambda p: p < F.size(b))
    df = df.withColumn(c, halves)

    def numbered(x: Column, j: Column) -> Column:
        """A repeated k-mer is hashed again with the number of equal ones before it; the array is sorted, so they stand together."""
        same = lambda back: F.coalesce(_hash(item(b, j - back)) == _hash(x), F.lit(False))
        before = F.aggregate(c, F.lit(0), lambda n, p: F.when((n + p <= j) & same(n + p), n + p).otherwise(n))
        return F.when((j > 0) & same(F.lit(1)), _packed(F.xxhash64(_hash(x), before), _position(x))).otherwise(x)

    df = df.withColumn(d, F.sort_array(F.transform(b, numbered)))
    df = df.withColumn(a, F.filter(d, lambda x, j: (j < 2) | (_slot(x) != _slot(item(d, j - 2)))))
    df = df.withColumn(b, F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda j: (j == 0) | (_slot(item(a, j)) != _slot(item(a, j - 1)))))

    def sketch(j: Column) -> Column:
        x, y = item(a, j), item(a, j + 1)
        pair = F.when(y.isNull() | (_slot(x) != _slot(y)), F.xxhash64(_hash(x))).when(_position(x) < _position(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
        return F.shiftleft(_slot(x), 32).bitwiseOR(pair.bitwiseAND(F.lit(0xFFFFFFFF)))

    whole = F.when(F.size(a) > 0, F.transform(b, sketch)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, whole).drop(a, b, c, d)


def as_text(sketch: Column) -> Column:
    """Ten hexadecimal digits for each part that is filled: two of its slot, eight of its sketch."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches among the parts that either text fills; 1 if neither fills any."""
    slots = lambda x: F.transform(x, lambda y: F.shiftright(y, 32))
    filled = F.size(F.array_union(slots(a), slots(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _keyed(documents: DataFrame) -> DataFrame:
    """``last, doc_id, h, text``: the keys that rows are in order of (null doc_ids last), and the text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("doc_id").isNull().cast("int").alias("last"), "doc_id", F.xxhash64("text").alias("h"), "text")


def range_borders(keys: DataFrame, rows_a_range: int = RANGE_ROWS, most: int = MOST_RANGES) -> list[tuple[int, int, int]]:
    """The first ``last, doc_id, h`` of each of at most ``most`` ranges of about equal numbers of rows, without the least."""
    keys = keys.select("last", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "h")
    many = max(1, min(most, -(-keys.count() // rows_a_range)))
    parts = keys.repartitionByRange(many, *keys.columns).groupBy(F.spark_partition_id().alias("part"))
    return sorted({tuple(r["first"]) for r in parts.agg(F.min(F.struct(*keys.columns)).alias("first")).collect()})[1:]


def _range_of(borders: list[tuple[int, int, int]]) -> Column:
    """How many borders are not above a row's keys, by halving."""
    if not borders:
        return F.lit(0)
    last, doc_id, h = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*borders, strict=True))
    at = lambda x, i: F.get(x, i)
    own = F.coalesce("doc_id", F.lit(0).cast("long"))

    def not_above(i: Column) -> Column:
        same = (at(last, i) == F.col("last")) & ((at(doc_id, i) < own) | ((at(doc_id, i) == own) & (at(h, i) <= F.col("h"))))
        return F.coalesce((at(last, i) < F.col("last")) | same, F.lit(False))

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(not_above(n + p - 1), n + p).otherwise(n))


def _repeats(rows: DataFrame, keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with those that repeat over ``most`` times there once; and of these ``doc_id, text, more``, if there are any."""
    hot = written(keys.groupBy("last", "doc_id", "h").agg(F.count("*").alias("n")).filter(F.col("n") > most), "repeats")
    many = hot.count()
    if not many:
        dropped(hot)
        return rows, None
    hot = hot.select(F.col("last").alias("hot_last"), F.col("doc_id").alias("hot_id"), F.col("h").alias("hot_h"))
    same = (F.col("last") == F.col("hot_last")) & F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("h") == F.col("hot_h"))
    met = F.broadcast(hot) if many <= BROADCAST_REPEATS else hot
    groups = written(rows.join(met, same, "left_semi").groupBy(*rows.columns).agg((F.count("*") - 1).alias("more")), "repeats")
    return rows.join(met, same, "left_anti").unionByName(groups.drop("more")), groups.filter("more > 0").select("doc_id", "text", "more")


def with_next(documents: DataFrame, rows_a_range: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, text, own, next_text, next_own``: each row with its sketches, and the next row's text and sketches."""
    rows = _keyed(documents)
    keys = written(rows.select("last", "doc_id", "h"), "keys")
    rows, repeats = _repeats(rows, keys, rows_a_range)
    rows = rows.withColumn("run", _range_of(range_borders(keys if repeats is None else rows, rows_a_range)))
    firsts = rows.groupBy("run").agg(F.min(F.struct("last", "doc_id", "h", "text")).alias("r")).select("run", F.col("r.text").alias("first_text"))
    runs = rows.select("run").distinct()  # at most MOST_RANGES rows
    order = Window.orderBy("run")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = runs.select("run", F.coalesce(F.lead("run").over(order), F.first("run").over(whole)).alias("_run"))
    heads = sketches(firsts.select(F.col("run").alias("_run"), "first_text"), "first_text", "first_own")
    links = after.join(heads, "_run").select("run", "first_text", "first_own")
    following = F.lead(F.struct("text", "own")).over(Window.partitionBy("run").orderBy("last", "doc_id", "h", "text"))
    led = sketches(rows.repartition("run"), "text", "own").withColumn("following", following).join(links, "run", "left")
    found = led.select("doc_id", "text", "own", F.coalesce("following.text", "first_text").alias("next_text"), F.coalesce("following.own", "first_own").alias("next_own"))
    if repeats is None:
        return found
    parts = repeats.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / COPIES)))).repartition("doc_id", "part")
    alike = sketches(parts, "text", "own").withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("more", (F.col("part") + 1) * COPIES))))
    return found.unionByName(alike.select("doc_id", "text", "own", F.col("text").alias("next_text"), F.col("own").alias("next_own")))


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """The fingerprint of each row of ``doc_id, text`` and of its edited text, whose last half is the next document's start."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    df = sketches(with_next(documents).withColumn("edited", edited), "edited", "changed")
    return df.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
